"""What a worker holds, and that windows change no result."""

import random
import re
import resource
import subprocess
import sys

import numpy as np

from hostlens.llm import language


def test_windows_change_no_ngram():
    r = random.Random(2)
    texts = ["".join(r.choice("abc é日") for _ in range(r.randrange(1, 90))) for _ in range(40)]
    whole = np.concatenate(list(language.grams(texts, 10**6)), axis=1)
    for window in (1, 2, 3, 7, 100, 1000):
        assert (np.concatenate(list(language.grams(texts, window)), axis=1) == whole).all()
    assert whole.shape[1] == sum(len(t) + 2 for t in texts)


def test_scores_do_not_depend_on_windows(monkeypatch):
    r = random.Random(3)
    model = language.LanguageModel(["a", "b", "c"], np.log(np.random.default_rng(1).random((3, language.BUCKETS))).astype(np.float32), np.zeros(3))
    texts = [None, "", "1 2", *["".join(r.choice("xyz ä") for _ in range(r.randrange(1, 300))) for _ in range(30)]]
    names, scores = model.score(texts)
    monkeypatch.setattr(language, "WINDOW", 11)
    again, others = model.score(texts)
    long = "1 ab, " * 30 + "Σ\u03a3 x"
    assert language.letters_only(long) == " " + re.sub(r"[\W\d_]+", " ", long).strip().lower() + " "
    assert names == again and np.allclose(scores, others, rtol=1e-9) and names[:3] == ["und"] * 3


def test_a_workers_peak_is_bounded():
    """Texts of 40 MB in all, one of them 20 MB long: a process that judges them peaks at less than 10 bytes a character more."""
    code = """
import resource, numpy as np, pyarrow as pa
from hostlens.llm import language
from hostlens.llm.common import cuts
texts = ["word on word " * 1600] * 1000 + ["another long text " * 1_100_000]
batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
model = language.LanguageModel(["a", "b"], np.zeros((2, language.BUCKETS), np.float32), np.zeros(2))
del texts
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for part in cuts(batch, "text", language.CUT):
    model.score(part.column("text").to_pylist())
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 10 * 20 and resource.getpagesize()

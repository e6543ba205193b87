"""URL filter: rules for hosts and paths, and for all other pages trust spread over the link graph.

1. A page's url is cut into host and path; the longest rule that fits decides where one does.
2. Hosts with pages that rules allow are trusted seeds, hosts with pages that rules block are blocked ones, each by the
   share of its pages (in billionths).
3. Links of the pages' html to other hosts are edges, weighted by the number of pages that hold one. Trust flows along the
   edges, distrust against them: who links to a blocked host is distrusted. Each round a host passes on
   `DAMPING` percent of what it holds, in proportion to the weights, and the seeds add the rest again
   (personalised PageRank). A host without links passes nothing on.
4. A host is blocked when its distrust exceeds its trust; a page that no rule fits has its host's verdict.

All sums are of whole numbers, rounded down, so they do not depend on the order of adding. Only DataFrame functions are used.
The html is read once; pages' facts, edges and each round's scores are written below the shared folder.
Edges of a host with more than 1/`SPLIT` of all edges are dealt over parts, and the verdicts of hosts with
more than 1/`SPLIT` of all pages are broadcast; of either there are fewer than `SPLIT` (for edges, per direction).

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is allowed; its links count for no host.
Null and empty html has no links. Repeated rows and ids are judged one by one and count in shares and weights; two rules that
fit and are equally long go by the longer host, then block over allow. Hosts without trust and distrust are
allowed. An empty table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import chosen, kept

#: (host, path, verdict); the list travels inside the plan, so it should stay within some hundred rules.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Rounds of the propagation, and percent of a host's score passed on in each.
ROUNDS, DAMPING = 20, 85
#: A seed all of whose pages a rule decides.
UNIT = 1_000_000_000
SPLIT = 1000

LINK = r"""<[Aa][\x09-\x0D\x20](?:[^<>]*?[\x09-\x0D\x20"'])?[Hh][Rr][Ee][Ff][\x09-\x0D\x20]*=[\x09-\x0D\x20]*["']?[\x09-\x0D\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<>\x09-\x0D\x20]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _decided(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The rule that fits and its verdict, null where none does."""
    best_first = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block"))
    rule, verdict = [], []
    for rule_host, rule_path, decision in best_first:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule.append(F.when(fits, rule_host + rule_path))
        verdict.append(F.when(fits, decision))
    nothing = F.lit(None).cast("string")
    return F.coalesce(*rule, nothing), F.coalesce(*verdict, nothing)


def page_facts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, decided, and the other hosts that the page links to."""
    cut = chosen(pages, page_id=F.col("page_id"), host=host_of(F.col("url")), path=path_of(F.col("url")), html=F.col("html"))
    rule, decided = _decided(F.col("host"), F.col("path"), rules)
    # [^<>] keeps a match within one tag, so unclosed markup is not scanned again and again.
    found = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1))
    links = F.array_distinct(F.transform(found, _lower))
    links = F.when(F.col("host") != "", F.array_remove(links, F.col("host"))).otherwise(F.array().cast("array<string>"))
    return cut.select("page_id", "host", "path", rule.alias("rule"), decided.alias("decided"), links.alias("links"))


def _larger(table: DataFrame, count: str, total: int) -> DataFrame:
    """Rows with more than 1/SPLIT of the total: fewer than SPLIT of them."""
    return table.filter(F.col(count) * SPLIT > total)


def _flows(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges as (kind, at, part, to, weight), one per direction, and per (kind, at) the weights' sum and the parts."""
    edges = kept(
        facts.select("host", F.explode("links").alias("link")).groupBy("host", "link").agg(F.count("*").alias("weight")), "edges"
    )
    directed = reduce(DataFrame.unionByName, (
        edges.select(F.lit(kind).alias("kind"), F.col(at).alias("at"), F.col(to).alias("to"), "weight")
        for kind, at, to in (("trust", "host", "link"), ("distrust", "link", "host"))
    ))
    sums = directed.groupBy("kind", "at").agg(F.sum("weight").alias("all_weight"), F.count("*").alias("n"))
    sums = kept(sums, "edge-sums")
    total = edges.count()
    hubs = _larger(sums, "n", total).select("kind", "at", (F.expr(f"n * {SPLIT} div {max(total, 1)}") + 1).alias("parts"))
    dealt = directed.join(F.broadcast(hubs), ["kind", "at"], "left").select(
        "kind", "at", F.pmod(F.xxhash64("to"), F.coalesce("parts", F.lit(1))).alias("part"), "to", "weight"
    )
    limits = sums.join(F.broadcast(hubs), ["kind", "at"], "left")
    limits = limits.select("kind", F.col("at").alias("host"), "all_weight", F.coalesce("parts", F.lit(1).cast("long")).alias("parts"))
    return kept(dealt, "flows"), limits


def propagated(facts: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """host, pages, trust, distrust of every host that has pages or is linked to."""
    share = lambda verdict: F.expr(f"count_if(decided = '{verdict}') * {UNIT} div count(*)")
    own = kept(
        facts.groupBy("host").agg(F.count("*").alias("pages"), share("allow").alias("allowed"), share("block").alias("blocked")), "hosts"
    )
    flows, limits = _flows(facts)
    hosts = own.unionByName(limits.select("host").distinct().join(own, "host", "left_anti"), allowMissingColumns=True)
    seed = F.create_map(F.lit("trust"), F.coalesce("allowed", F.lit(0)), F.lit("distrust"), F.coalesce("blocked", F.lit(0)))
    seeds = hosts.select("host", "pages", F.explode(seed).alias("kind", "seed"))
    base = F.expr(f"seed * {100 - damping} div 100")
    scores = seeds.join(limits, ["host", "kind"], "left").select("host", "pages", "kind", "all_weight", "parts", base.alias("base"), "seed")
    scores = kept(scores.withColumnRenamed("seed", "score"), "scores")
    passed = F.expr(f"cast(score as decimal(20)) * cast(weight * {damping} as decimal(18)) div cast(all_weight * 100 as decimal(20))")
    for _ in range(rounds):
        spread = scores.filter((F.col("score") > 0) & F.col("all_weight").isNotNull()).select(
            "kind", F.col("host").alias("at"), "score", "all_weight", F.explode(F.expr("sequence(0, parts - 1)")).alias("part")
        )
        moved = flows.join(spread, ["kind", "at", "part"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(passed).alias("moved"))
        after = scores.join(moved, ["kind", "host"], "left").withColumn("last", F.col("score"))
        after = after.withColumn("score", F.col("base") + F.coalesce("moved", F.lit(0))).drop("moved")
        scores = kept(after, "scores")
        if scores.filter("score <> last").isEmpty():
            break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score"))).alias(kind)
    return scores.groupBy("host").agg(F.max("pages").alias("pages"), of("trust"), of("distrust"))


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, rounds: int = ROUNDS, damping: int = DAMPING
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages."""
    facts = kept(page_facts(pages, rules), "pages")
    verdict = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow").alias("by_host")
    hosts = kept(propagated(facts, rounds, damping).filter("pages is not null").select("host", "pages", verdict), "verdicts")
    columns = ["page_id", "host", "path", "rule"]
    ruled = facts.filter(F.col("decided").isNotNull()).select(*columns, F.col("decided").alias("verdict"))
    large = _larger(hosts, "pages", facts.count()).select("host", F.col("by_host").alias("by_large"))
    free = facts.filter(F.col("decided").isNull()).join(F.broadcast(large), "host", "left")
    at_once = free.filter(F.col("by_large").isNotNull()).select(*columns, F.col("by_large").alias("verdict"))
    rest = free.filter(F.col("by_large").isNull()).join(hosts, "host").select(*columns, F.col("by_host").alias("verdict"))
    return ruled.unionByName(at_once).unionByName(rest)

"""One query per operator over the sample feed of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostlens.functions import exprs
from hostlens.operators import alerts as al
from hostlens.operators import hosts as ho
from hostlens.operators import incidents as inc
from hostlens.operators import ingest as ing
from hostlens.operators import details, kpis, outbox, retention, search, series
from hostlens.operators import rules as ru
from hostlens.operators import snapshot as sn
from hostlens.operators import validate as va
from hostlens.params import Params
from hostlens.plans.replay import Replay, envelopes, replay
from hostlens.schemas import ALERT_KEY, IDENTITY, INSTANCE, SAMPLE_COLUMNS
from hostlens.session import configure, work_folder
from hostlens.sources import feed as fd
from hostlens.sources import spool as sp
from hostlens.sources import stored
from hostlens.sources.envelopes import envelope_samples, read_envelopes
from hostlens.sources.rule_files import read_rules
from hostlens.streaming import pipeline as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW, SLICE = fd.NOW, fd.SLICE_SECONDS
HALF = fd.BASE + fd.SPAN / 2


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(configure(spark), folder)

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return build


def _alerts(spark: SparkSession, folder: str) -> DataFrame:
    return al.evaluate_alerts(fd.samples(spark, folder), fd.rules(spark), SLICE)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a stored table, for what reads them more than once."""
    spark = rows.sparkSession
    path = work_folder(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _alert_table(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(_alerts(spark, folder), "alerts")


def _alerts_and_samples(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both as stored tables: the copies are told apart once, not again for each pass over the samples."""
    samples = _stored(fd.samples(spark, folder), "samples")
    return _stored(al.evaluate_alerts(samples, fd.rules(spark), SLICE), "alerts"), samples


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    return ho.host_registry(fd.samples(spark, folder))


def _with_total(page: sn.Page) -> DataFrame:
    return page.rows.withColumn("total", page.total.scalar())


def _batch_id() -> Column:
    return F.concat_ws("|", "host", F.floor(F.col("received_at") / 30).cast("string"))


# --- ingest -------------------------------------------------------------------


@query
def dedup_samples(spark, folder):
    return fd.samples(spark, folder)


@query
def append_samples(spark, folder):
    """The second half of the feed, written to a table that holds the first."""
    raw, path = fd.feed(spark, folder), work_folder(spark, "append")
    stored = ing.append_samples(raw.filter(F.col("received_at") < HALF), path, 0)
    return ing.append_samples(raw.filter(F.col("received_at") >= HALF), path, 1, stored).select(*SAMPLE_COLUMNS)


@query
def ingest_receipts(spark, folder):
    new = fd.feed(spark, folder).withColumn("batch_id", _batch_id())
    return ing.ingest_receipts(new, ing.accept_samples(new), _alerts(spark, folder))


def _dirty(spark, folder) -> DataFrame:
    raw = fd.feed(spark, folder).filter(F.col("seq") >= 0)
    return raw.withColumns(
        {
            "pid": F.when(F.col("seq") % 97 == 0, -1).otherwise(F.col("pid")),
            "memory_percent": F.when(F.col("seq") % 89 == 0, 150.0).otherwise(F.col("memory_percent")),
            "process_name": F.when(F.col("seq") % 83 == 0, " \t ").otherwise(F.col("process_name")),
        }
    )


@query
def validate_samples(spark, folder):
    rows = va.validate_samples(_dirty(spark, folder))
    return rows.select("seq", "host", "pid", "process_name", "valid", F.array_join("errors", ",").alias("errors"))


@query
def admit_batches(spark, folder):
    rows = va.validate_samples(_dirty(spark, folder)).withColumn("batch_id", _batch_id())
    admission = ing.admit_batches(rows, max_samples=18)
    taken = admission.accepted.select("batch_id", F.lit("accepted").alias("verdict"))
    turned = admission.rejected.select("batch_id", F.col("reason").alias("verdict"))
    return taken.unionByName(turned).groupBy("batch_id", "verdict").agg(F.count("*").alias("samples"))


@query
def normalize_observations(spark, folder):
    odd = F.col("seq") % 2 == 1
    raw = fd.feed(spark, folder).withColumns(
        {
            "create_time": F.when(F.col("seq") % 31 == 0, 0.0).otherwise(F.col("create_time")),
            "process_name": F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("process_name")),
            "cpu_percent": F.col("cpu_percent") - 100,
            "memory_percent": F.when(odd, F.col("memory_percent") * 3 - 20),
            "memory_rss": F.when(odd, F.col("memory_rss")),
            "read_bytes": F.col("read_bytes") - 1_000_000,
        }
    )
    return ing.normalize_observations(raw)


@query
def mask_cpu_baseline(spark, folder):
    rows = ing.mask_cpu_baseline(fd.samples(spark, folder), fd.CYCLE_SECONDS)
    return rows.select("seq", *IDENTITY, "cpu_percent")


@query
def chunk_batches(spark, folder):
    cycle = F.floor(F.col("timestamp") / fd.CYCLE_SECONDS) * fd.CYCLE_SECONDS
    rows = ing.chunk_batches(fd.samples(spark, folder).withColumn("cycle", cycle), size=4, cycle="cycle", pid_span=8)
    return rows.select(
        "host",
        "cycle",
        "chunk",
        "sample_count",
        F.get(F.col("samples"), F.lit(0))["seq"].alias("first_seq"),
        F.element_at("samples", -1)["seq"].alias("last_seq"),
    )


@query
def upgrade_samples(spark, folder):
    """A table without receipt times and states, with the old user column and copies."""
    old = fd.feed(spark, folder).withColumn("user", F.col("username")).drop("received_at", "state", "memory_rss")
    old = old.withColumn("username", F.when(F.col("seq") % 2 == 0, F.col("username")))
    return retention.with_compat_fields(retention.upgrade_samples(old, NOW))


@query
def prune_samples(spark, folder):
    pruned = retention.prune_samples(fd.samples(spark, folder), NOW, fd.PRUNE_SECONDS / 86_400)
    return pruned.kept.select("seq", *IDENTITY).withColumn("deleted_count", pruned.deleted.scalar())


@query
def maintained_samples(spark, folder):
    """The feed stretched to 30 days, ingested in three batches; after each, upkeep with a horizon of 15 days.

    ``deleted_again`` is what a further run at the same time removes.
    """
    slow = lambda name: (F.lit(float(fd.BASE)) + (F.col(name) - fd.BASE) * 1000).alias(name)
    raw = fd.feed(spark, folder).withColumns({n: slow(n) for n in ("timestamp", "received_at")})
    root, width = work_folder(spark, "upkeep"), fd.SPAN * 1000.0
    number = F.greatest(F.lit(0), F.least(F.lit(2), F.floor((F.col("received_at") - fd.BASE) / F.lit(width / 3))))
    for batch in range(3):
        new = raw.filter(number == batch).withColumn("batch_id", _batch_id())
        ing.append_samples(new, f"{root}/samples", batch, stored.read_current(spark, root, batch) if batch else None)
        stored.upkeep(spark, root, fd.BASE + width * (batch + 1) / 3, 15, 1)
    again = stored.upkeep(spark, root, fd.BASE + width, 15, 1)
    stored.drop_unused(spark, root, 1, 2)
    rows = stored.read_current(spark, root)
    return rows.select("seq", *IDENTITY, "cpu_percent").withColumn("deleted_again", F.lit(again.deleted).cast("long"))


# --- envelopes and spools --------------------------------------------------------


def _legacy_lines(spark, folder) -> DataFrame:
    """Envelope lines with the old field names in every second batch, one of them broken."""
    lines = envelopes(fd.feed(spark, folder))
    value = F.col("value")
    old = F.regexp_replace(F.regexp_replace(value, '"process_name":', '"name":'), '"username":', '"user":')
    old = F.regexp_replace(F.regexp_replace(old, '"host":', '"hostname":'), '"samples":', '"processes":')
    odd = F.when(F.col("chunk") % 2 == 1, old)
    torn = F.when(F.col("chunk") % 5 == 4, F.concat(F.lit("{"), value))
    return lines.select("chunk", F.coalesce(torn, odd, value).alias("value"))


@query
def envelope_ingest(spark, folder):
    """Written envelopes read back: old names resolved, torn lines turned away."""
    path = work_folder(spark, "envelopes")
    _legacy_lines(spark, folder).select("value").write.text(path)
    return envelope_samples(read_envelopes(spark, path, replay=True)).drop("batch_id")


def _unstamped(spark, folder, follow=None) -> Replay:
    """The feed through the ingest stream without replay fields: order comes from files, lines and triggers alone."""
    return replay(spark, folder, follow, stamped=False)


@query
def envelope_alerts(spark, folder):
    samples = _unstamped(spark, folder).samples
    return al.evaluate_alerts(samples, fd.rules(spark), SLICE)


@query
def envelope_transitions(spark, folder):
    rules = fd.rules(spark)
    run = _unstamped(spark, folder, lambda s, r: st.start_changes(st.stream_alerts(s, rules), r.changes, r.checkpoint))
    return spark.read.parquet(run.changes).drop("epoch")


@query
def arrival_numbers(spark, folder):
    """Numbers of three triggers' samples: as many as samples were sent, without repeats, rising in each host's order."""
    rows = _unstamped(spark, folder).samples
    return rows.groupBy("host").agg(
        F.count("*").alias("accepted"),
        F.countDistinct("seq").alias("numbers"),
        # The few triggers are gathered; a second distinct count would double the rows of the first.
        F.size(F.collect_set("ingest_batch")).cast("long").alias("triggers"),
    )


@query
def typed_envelopes(spark, folder):
    """Envelopes of one sample each whose values are written in every JSON type: why each is turned away."""
    lines = _mistyped(fd.feed(spark, folder))
    path = work_folder(spark, "typed")
    lines.select("value").write.text(path)
    rows = read_envelopes(spark, path).withColumn("event", F.regexp_extract("value", '"event": (-?[0-9]+)', 1).cast("long"))
    return rows.select("event", "reason", F.array_join(F.array_sort(F.flatten("samples.errors")), ",").alias("errors"))


def _mistyped(raw: DataFrame) -> DataFrame:
    kind = F.pmod("seq", F.lit(16))

    def odd(number: int, text: str, value: Column) -> Column:
        return F.when(kind == number, F.lit(text)).otherwise(value)

    quoted = F.concat(F.lit('"'), F.col("process_name"), F.lit('"'))
    pid = odd(0, "7.5", odd(1, '"7"', odd(2, "true", odd(3, '"7.0"', odd(4, '"7e0"', odd(5, "[7]", odd(15, "4294967296", F.col("pid").cast("string"))))))))
    name = odd(6, "12", odd(7, '{"a": 1}', odd(8, "null", odd(9, '" spaced "', quoted))))
    cpu = odd(10, "NaN", odd(11, '"1e1"', odd(12, "null", odd(13, '"12d"', F.lit("1.5")))))
    host = odd(14, "12", F.lit('"h"'))
    body = ['{"event": ', F.col("seq").cast("string"), ', "host": ', host, ', "samples": [{"pid": ', pid, ', "process_name": ', name, ', "cpu_percent": ', cpu,
            ', "create_time": 1, "timestamp": 2.5, "memory_percent": 3, "memory_rss": 4, "read_bytes": 5.0, "write_bytes": "6"}]}']
    return raw.withColumn("value", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in body]))


def _spooled(spark, folder, keep: int) -> DataFrame:
    """Spool files, one per host, each in arrival order; every seventh line is torn."""
    path = work_folder(spark, "spool")
    lines = envelopes(fd.feed(spark, folder), size=10)
    torn = F.when(F.col("chunk") % 7 == 3, F.concat(F.lit("{"), F.col("value"))).otherwise(F.col("value"))
    (
        lines.withColumn("value", torn)
        .repartition("host")
        .sortWithinPartitions("host", "chunk")
        .select("host", "value")
        .write.partitionBy("host")
        .text(path)
    )
    return sp.read_spool(spark, path, keep)


def _spool_line(value: str = "value") -> list[Column]:
    return [
        F.get_json_object(value, "$.host").alias("host"),
        F.get_json_object(value, "$.samples[0].seq").cast("long").alias("first_seq"),
    ]


@query
def read_spool(spark, folder):
    return _spooled(spark, folder, 5).select(*_spool_line(), "newest")


@query
def compact_spool(spark, folder):
    """Compacted to eight batches per host, then read again for the newest six."""
    path = work_folder(spark, "compacted")
    sp.compact_spool(_spooled(spark, folder, 8), path)
    return sp.read_spool(spark, path, 6).select(*_spool_line(), "newest")


@query
def append_spool(spark, folder):
    """Spools of five batches with one new batch each, kept to the newest four."""
    pending = _spooled(spark, folder, 5)
    lines = envelopes(fd.feed(spark, folder), size=10)
    spools = pending.select("spool", F.get_json_object("value", "$.host").alias("host")).distinct()
    fresh = lines.filter(F.col("chunk") == 0).join(spools, "host").select("spool", F.col("chunk").alias("position"), "value")
    return sp.append_spool(pending, fresh, 4).select(*_spool_line(), "newest")


@query
def replay_order(spark, folder):
    pending = _spooled(spark, folder, 5)
    fresh = envelopes(fd.feed(spark, folder), size=10).select(F.col("chunk").cast("int").alias("position"), "value")
    return sp.replay_order(pending, fresh).select("is_new", "position", *_spool_line())


# --- snapshots and histories --------------------------------------------------------


@query
def latest_samples(spark, folder):
    return sn.latest_by_cpu(fd.samples(spark, folder), NOW, 600)


@query
def list_processes(spark, folder):
    rows = fd.samples(spark, folder)
    return _with_total(sn.list_processes(rows, _alert_table(spark, folder), NOW, page=2, page_size=20))


@query
def list_processes_search(spark, folder):
    page = sn.list_processes(
        fd.samples(spark, folder), _alert_table(spark, folder), NOW,
        search="PROC-1%.exe", state="RUNNING", sort="process_name", order="asc", page_size=250,
    )
    return _with_total(page)


@query
def list_processes_alerting(spark, folder):
    page = sn.list_processes(
        fd.samples(spark, folder), _alert_table(spark, folder), NOW,
        cpu_min=10, memory_min=5, alert_only=True, sort="memory_rss", page_size=250,
    )
    return _with_total(page)


@query
def top_processes(spark, folder):
    latest = sn.latest_samples(fd.samples(spark, folder), NOW, 3600)
    ranked = [
        sn.top_processes(latest, metric).select(F.lit(metric).alias("metric"), "host", "rank", *INSTANCE[1:], metric)
        .withColumnRenamed(metric, "value")
        for metric in ("cpu_percent", "memory_percent")
    ]
    return ranked[0].unionByName(ranked[1])


@query
def resolve_instance(spark, folder):
    return sn.resolve_instance(fd.samples(spark, folder))


@query
def instance_current(spark, folder):
    return sn.instance_current(fd.samples(spark, folder)).select(*SAMPLE_COLUMNS, "instance_id")


@query
def instance_history(spark, folder):
    rows = sn.instance_history(fd.samples(spark, folder), NOW, 2000, limit=12, slice_seconds=SLICE)
    return rows.select("seq", *IDENTITY, "position")


@query
def instance_series(spark, folder):
    return sn.instance_series(sn.instance_history(fd.samples(spark, folder), NOW, slice_seconds=SLICE))


@query
def history(spark, folder):
    page = search.history(fd.samples(spark, folder), search.Cut(500, 5), (fd.BASE + 100, HALF), "user-1", host="host-03")
    return _with_total(page)


@query
def history_pages(spark, folder):
    """Four pages of a table that three triggers have filled, each from behind the last row of the one before."""
    samples, parts, last = replay(spark, folder).samples.select(*SAMPLE_COLUMNS), [], None
    for number in range(4):
        page = search.history(samples, search.Cut(40, after=last), host="host-03").rows.withColumn("page", F.lit(number))
        # Forty rows, read once: as a plan the page would be searched for again in the result.
        rows = page.collect()
        parts.append(spark.createDataFrame(rows, page.schema))
        last = min([(r.timestamp, r.seq) for r in rows], default=last)
    return reduce(DataFrame.unionByName, parts).select("page", "seq", *IDENTITY)


# --- hosts, series, KPIs ----------------------------------------------------------------


@query
def host_registry(spark, folder):
    """Merged from the registries of two halves."""
    rows = fd.samples(spark, folder)
    early = ho.host_registry(rows.filter(F.col("received_at") < HALF))
    return ho.host_registry(rows.filter(F.col("received_at") >= HALF), early)


def _host_summary(spark, folder, params: Params = Params()) -> DataFrame:
    rows = fd.samples(spark, folder)
    return ho.host_summary(
        ho.host_registry(rows), sn.latest_samples(rows, NOW, 3600), _alerts(spark, folder), NOW, params
    )


@query
def host_summary(spark, folder):
    rows = _host_summary(spark, folder)
    return rows.withColumn("cpu_percent", F.round("cpu_percent", 6)).withColumn(
        "memory_percent", F.round("memory_percent", 6)
    )


@query
def host_cards(spark, folder):
    return ho.host_cards(_host_summary(spark, folder, Params(stale_after=30, offline_after=300))).select("host", "status", "process_count")


@query
def host_activity(spark, folder):
    rows = fd.samples(spark, folder)
    return ho.host_activity(ho.host_registry(rows), rows, NOW, 2400)


@query
def search_hosts(spark, folder):
    return search.search_hosts(_registry(spark, folder), "ST-0").select("host", "sample_count")


@query
def global_search(spark, folder):
    rows = fd.samples(spark, folder)
    return search.global_search(rows, ho.host_registry(rows), _alert_table(spark, folder), " host-0 ", NOW)


@query
def page_info(spark, folder):
    page = sn.list_processes(fd.samples(spark, folder), _alerts(spark, folder), NOW, page=2, page_size=20)
    return search.page_info(page.total, 2, 20)


@query
def search_hosts_like(spark, folder):
    return search.search_hosts(_registry(spark, folder), "ST_0%5", wildcards=True).select("host", "sample_count")


@query
def overview(spark, folder):
    view = details.overview(fd.samples(spark, folder), _alert_table(spark, folder), NOW, window=1200)
    busy = view.activity.groupBy("host").agg(F.sum("value").alias("received"), F.max("height").alias("height"))
    rows = view.hosts.select("host", "status", "process_count", "active_alert_count").join(busy, "host")
    return rows.withColumn("live_hosts", view.kpis.select("live_hosts").scalar())


@query
def host_detail(spark, folder):
    """The parts of one host's page as labelled rows."""
    view = details.host_detail(fd.samples(spark, folder), _alert_table(spark, folder), "host-02", NOW)

    def part(name: str, frame: DataFrame, place: Column, value: Column) -> DataFrame:
        return frame.select(F.lit(name).alias("part"), place.cast("string").alias("place"), value.cast("double").alias("value"))

    parts = [
        part("summary", view.summary, F.col("status"), F.col("sample_count")),
        part("top_cpu", view.top_cpu, F.col("rank"), F.col("cpu_percent")),
        part("top_memory", view.top_memory, F.col("rank"), F.col("memory_percent")),
        part("recent_alerts", view.recent_alerts, F.col("rank"), F.col("triggered_at")),
        part("series", view.series.groupBy("series").agg(F.count("*").alias("n")), F.col("series"), F.col("n")),
    ]
    rows = parts[0]
    for frame in parts[1:]:
        rows = rows.unionByName(frame)
    return rows


@query
def process_detail(spark, folder):
    """The newest instance of one pid: its history with its alerts counted along."""
    view = details.process_detail(fd.samples(spark, folder), _alert_table(spark, folder), "host-01", 13, None, NOW)
    rows = view.history.select("create_time", "timestamp", "position", "cpu_percent")
    return rows.withColumn("alerts", view.alerts.agg(F.count("*")).scalar()).withColumn(
        "current_at", view.current.select("timestamp").scalar()
    )


@query
def metric_series(spark, folder):
    return series.metric_series(fd.samples(spark, folder), NOW, 2400, host="host-01")


@query
def alert_series(spark, folder):
    return series.alert_series(_alerts(spark, folder), NOW, 3600)


@query
def metrics_summary(spark, folder):
    return series.metrics_summary(fd.samples(spark, folder), _alerts(spark, folder), NOW, 3600)


@query
def series_bounds(spark, folder):
    points = sn.instance_series(sn.instance_history(fd.samples(spark, folder), NOW, slice_seconds=SLICE))
    return series.series_bounds(points, [*INSTANCE, "series"])


@query
def kpi_summary(spark, folder):
    rows = fd.samples(spark, folder)
    return kpis.kpi_summary(rows, ho.host_registry(rows), _alerts(spark, folder), NOW, window=1800)


# --- rules ----------------------------------------------------------------------------------


@query
def current_rules(spark, folder):
    return ru.current_rules(fd.rule_log(fd.read_events(spark, folder))).rules


@query
def rule_rejects(spark, folder):
    return ru.current_rules(fd.rule_log(fd.read_events(spark, folder))).rejects


@query
def list_rules(spark, folder):
    rules = ru.current_rules(fd.rule_log(fd.read_events(spark, folder))).rules
    return ru.list_rules(rules, enabled=True).select("rule_id", "name", "enabled")


@query
def validate_rules(spark, folder):
    seq = F.col("change_seq")
    log = fd.rule_log(fd.read_events(spark, folder)).withColumns(
        {
            "rule_id": F.when(seq % 11 == 0, F.concat(F.lit("-"), "rule_id")).otherwise(F.concat(F.lit(" "), "rule_id")),
            "name": F.when(seq % 13 == 0, " \n").otherwise(F.col("name")),
            "threshold": F.col("threshold") - 1,
            "severity": F.when(seq % 17 == 0, "fatal").when(seq % 3 == 0, F.col("severity")),
            "cooldown": F.when(seq % 19 == 0, 700_000.0),
        }
    )
    rows = ru.validate_rules(log)
    return rows.select("change_seq", "rule_id", "name", "severity", "cooldown", "valid", F.array_join("errors", ",").alias("errors"))


@query
def read_rule_files(spark, folder):
    """Rules written as JSON lines, every second with the old id name, read back and checked."""
    log = fd.rule_log(fd.read_events(spark, folder))
    fields = ["name", "metric", "operator", "threshold", "consecutive_samples", "enabled"]
    old = F.to_json(F.struct(F.col("rule_id").alias("id"), *fields))
    path = work_folder(spark, "rules")
    lines = log.select(F.when(F.col("change_seq") % 2 == 0, old).otherwise(F.to_json(F.struct("rule_id", *fields))).alias("value"))
    lines.write.text(path)
    return ru.validate_rules(read_rules(spark, path)).drop("errors")


@query
def rule_texts(spark, folder):
    log = fd.rule_log(fd.read_events(spark, folder))
    return log.select(
        "change_seq",
        exprs.rule_condition_text(F.col("metric"), F.col("operator"), F.col("threshold")).alias("condition"),
        exprs.duration_text(F.col("change_seq").cast("double")).alias("held_for"),
    )


@query
def surviving_states(spark, folder):
    """States left after deleting the rules that only inform."""
    rules = fd.rules(spark)
    states = al.alert_states(fd.samples(spark, folder), rules, SLICE)
    return ru.surviving_states(states, rules.filter(F.col("severity") != "info"))


# --- alerts ----------------------------------------------------------------------------------


@query
def evaluate_alerts(spark, folder):
    return _alerts(spark, folder)


@query
def alert_states(spark, folder):
    return al.alert_states(fd.samples(spark, folder), fd.rules(spark), SLICE)


@query
def get_alert_state(spark, folder):
    states = al.alert_states(fd.samples(spark, folder), fd.rules(spark), SLICE)
    return al.get_alert_state(states, "cpu-any", "host-01", 13, fd.BASE + 1296.0)


@query
def get_alert(spark, folder):
    """The newest alert of host-01, looked up by its id."""
    alerts = _alert_table(spark, folder)
    newest = search.list_alerts(alerts, search.Cut(1), host="host-01").rows
    wanted = al.with_alert_id(newest).first()
    return al.get_alert(alerts, wanted["alert_id"] if wanted else "").drop("alert_id")


@query
def alert_transitions(spark, folder):
    return al.alert_transitions(fd.samples(spark, folder), fd.rules(spark), SLICE)


@query
def alerts_from_transitions(spark, folder):
    rules = fd.rules(spark)
    return al.alerts_from_transitions(al.alert_transitions(fd.samples(spark, folder), rules, SLICE), rules)


@query
def list_alerts(spark, folder):
    page = search.list_alerts(
        _alert_table(spark, folder), search.Cut(50, 10), since=fd.BASE + 300.0, text="PROC-2", status="resolved", severity="warning"
    )
    return _with_total(page)


@query
def list_alerts_active(spark, folder):
    """The six newest active alerts."""
    return _with_total(search.list_alerts(_alert_table(spark, folder), search.Cut(6), status="active"))


@query
def alerts_summary(spark, folder):
    return al.alerts_summary(_alerts(spark, folder))


@query
def recent_alerts(spark, folder):
    return al.recent_alerts(_alerts(spark, folder)).select("host", "rank", "rule_id", "pid", "create_time", "triggered_at")


@query
def instance_alerts(spark, folder):
    rows = al.instance_alerts(_alerts(spark, folder))
    return rows.select(*INSTANCE, "rank", "rule_id", "triggered_at", "status")


@query
def active_alert_for(spark, folder):
    """The active alert of the rule and instance that have the newest one."""
    alerts = _alert_table(spark, folder)
    newest = search.list_alerts(alerts, search.Cut(1), status="active").rows.first()
    return al.active_alert_for(alerts, *[newest[c] for c in ("rule_id", *INSTANCE)]) if newest else alerts.limit(0)


@query
def notification_outbox(spark, folder):
    messages = outbox.notification_outbox(_alert_table(spark, folder), email_configured=False)
    body = F.when(F.col("action") == "webhook", F.get_json_object("body", "$.alert")).otherwise(F.col("body"))
    return messages.select(
        "delivery_seq", *ALERT_KEY, "action", "delivery", "subject",
        F.get_json_object("body", "$.event").alias("event"),
        F.get_json_object(body, "$.current_value").cast("double").alias("body_value"),
        F.get_json_object(body, "$.status").alias("body_status"),
    )


# --- incidents ----------------------------------------------------------------------------------


@query
def incident_samples(spark, folder):
    rows = inc.incident_samples(*_alerts_and_samples(spark, folder), 600, cap=15)
    return rows.select(
        F.substring_index("alert_id", "|", 1).alias("rule_id"), "seq", "triggered_at", "timestamp", "newest", "value"
    )


@query
def incident_summary(spark, folder):
    return inc.incident_summary(*_alerts_and_samples(spark, folder))


@query
def incident_summary_hour(spark, folder):
    return inc.incident_summary(*_alerts_and_samples(spark, folder), 3600, cap=20)


@query
def incident_header(spark, folder):
    return inc.incident_header(_alerts(spark, folder)).select(
        *ALERT_KEY, "severity", "status", "started_time", "age_seconds_at_alert"
    )


@query
def incident_timeline(spark, folder):
    rows = inc.incident_timeline(*_alerts_and_samples(spark, folder), 3600)
    key = F.split("alert_id", r"\|")
    return rows.select(
        key.getItem(0).alias("rule_id"),
        key.getItem(1).alias("host"),
        key.getItem(2).cast("long").alias("pid"),
        key.getItem(4).cast("double").alias("triggered_at"),
        *[c for c in rows.columns if c != "alert_id"],
    )


@query
def incident_evidence(spark, folder):
    return inc.incident_evidence(*_alerts_and_samples(spark, folder))


@query
def incident_evidence_hour(spark, folder):
    return inc.incident_evidence(*_alerts_and_samples(spark, folder), 3600)


@query
def incident_documents(spark, folder):
    """The nested documents, with a few of their parts laid open."""
    docs = inc.incident_documents(*_alerts_and_samples(spark, folder))
    last = F.element_at("timeline", -1)
    return docs.select(
        *[F.col(f"incident.{c}").alias(c) for c in ALERT_KEY],
        "process.started_time",
        "summary.sample_count",
        "summary.delta",
        F.size("timeline").alias("timeline_rows"),
        last["label"].alias("last_label"),
        F.array_join("evidence", "\n").alias("evidence"),
        F.col("window.start").alias("window_start"),
        F.col("window.seconds").alias("window_seconds"),
    )


# --- texts ----------------------------------------------------------------------------------------


@query
def value_bands(spark, folder):
    metric, points = F.col("metric"), "stack(3, 'cpu_percent', cpu_percent, 'memory_percent', memory_percent, 'memory_rss', cast(memory_rss AS double)) AS (metric, value)"
    rows = fd.samples(spark, folder).select("seq", F.expr(points))
    return rows.select(
        "seq",
        "metric",
        exprs.metric_label(metric).alias("label"),
        exprs.short_metric_label(metric).alias("short_label"),
        exprs.format_value(metric, F.col("value")).alias("text"),
        exprs.value_state(metric, F.col("value")).alias("band"),
    )


@query
def byte_texts(spark, folder):
    size = (F.col("read_bytes") * F.col("write_bytes")).cast("double")
    return fd.samples(spark, folder).select(
        "seq", exprs.report_bytes(size).alias("report"), exprs.format_bytes(F.col("write_bytes")).alias("display")
    )


@query
def clock_texts(spark, folder):
    at = F.col("timestamp")
    return fd.samples(spark, folder).select(
        "seq", exprs.fmt_time(at).alias("clock"), exprs.utc_iso(at).alias("iso"), exprs.relative_time(at, NOW).alias("ago")
    )


# --- streams ----------------------------------------------------------------------------------------


@query
def stream_ingest(spark, folder):
    return replay(spark, folder).samples.select(*SAMPLE_COLUMNS)


@query
def stream_dedup(spark, folder):
    """The feed as it was sent, copies included: the copies come in a trigger of their own, after all others."""
    configure(spark, streaming=True)
    root, raw = work_folder(spark, "sent"), fd.feed(spark, folder).withColumn("batch_id", F.lit("b"))
    for batch, part in enumerate(["seq >= 0 AND seq % 2 = 0", "seq >= 0 AND seq % 2 = 1", "seq < 0"]):
        ing.write_samples(raw.filter(part), f"{root}/samples/ingest_batch={batch}")
        stream = st.stream_dedup(st.stream_table(spark, f"{root}/samples"))
        st.start_changes(stream, f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/changes").select(*IDENTITY, "cpu_percent")


def _stream_transitions(spark, folder) -> DataFrame:
    rules = fd.rules(spark)
    run = replay(spark, folder, lambda s, r: st.start_changes(st.stream_alerts(s, rules), r.changes, r.checkpoint))
    return spark.read.parquet(run.changes).drop("epoch")


@query
def stream_transitions(spark, folder):
    return _stream_transitions(spark, folder)


@query
def stream_expiry(spark, folder):
    """Transitions where an instance that is silent for ten minutes of receipt time starts anew."""
    rules = fd.rules(spark)
    start = lambda s, r: st.start_changes(st.stream_alerts(s, rules, 600.0, 0.0), r.changes, r.checkpoint)
    return spark.read.parquet(replay(spark, folder, start).changes).drop("epoch")


@query
def stream_state(spark, folder):
    """The state left of the same stream: instances heard of in the last ten minutes."""
    rules = fd.rules(spark)
    start = lambda s, r: st.start_changes(st.stream_alerts(s, rules, 600.0, 0.0), r.changes, r.checkpoint)
    run = replay(spark, folder, start)
    return st.alert_state_rows(spark, run.checkpoint).select(*INSTANCE, "rule_id", "true_since", "run", "last_at", "triggered_at")


@query
def stream_restart(spark, folder):
    """The alert stream loses its checkpoint before the last slice and starts again from the stored samples' states."""
    rules, parts = fd.rules(spark), []

    def follow(stream: DataFrame, run: Replay) -> StreamingQuery:
        seeds, number = None, len(parts)
        if number == 2:
            seen = run.samples.filter(F.col("ingest_batch") < number)
            stream = stream.filter(F.col("ingest_batch") >= number)
            seeds = st.alert_seeds(al.alert_states(seen, rules, SLICE))
        parts.append(f"{run.changes}-{number // 2}")
        return st.start_changes(st.stream_alerts(stream, rules, seeds=seeds), parts[-1], f"{run.checkpoint}-{number // 2}")

    replay(spark, folder, follow)
    return spark.read.parquet(parts[0]).unionByName(spark.read.parquet(parts[2])).drop("epoch")


@query
def stream_living_rules(spark, folder):
    """Transitions where one rule is added after the first of three passes."""
    rules, passes = fd.rules(spark), []

    def follow(stream: DataFrame, run: Replay) -> StreamingQuery:
        passes.append(run.changes)
        known = rules if len(passes) > 1 else rules.filter(F.col("rule_id") != "cpu-any")
        return st.start_changes(st.stream_alerts(stream, known), run.changes, run.checkpoint)

    replay(spark, folder, follow)
    return spark.read.parquet(passes[0]).drop("epoch")


@query
def stream_receipts(spark, folder):
    """Per host what the receipts of the ingest stream say, alerts included."""
    rules = fd.rules(spark)
    run = replay(spark, folder, lambda s, r: st.start_changes(st.stream_alerts(s, rules), r.changes, r.checkpoint))
    receipts = st.streamed_receipts(spark.read.parquet(f"{run.table}/receipts"), run.samples, spark.read.parquet(run.changes))
    return receipts.groupBy("host").agg(
        *[F.sum(n).alias(n) for n in ("accepted", "duplicates", "alerts_triggered")]
    )


@query
def stream_alerts(spark, folder):
    return al.alerts_from_transitions(_stream_transitions(spark, folder), fd.rules(spark))


@query
def stream_hosts(spark, folder):
    run = replay(spark, folder, lambda s, r: st.start_changes(st.stream_hosts(s), r.changes, r.checkpoint))
    return st.newest_rows(spark.read.parquet(run.changes), ["host"])


@query
def stream_metric_series(spark, folder):
    run = replay(spark, folder, lambda s, r: st.start_changes(st.stream_metric_series(s, 60), r.changes, r.checkpoint))
    return st.combined_series(st.newest_rows(spark.read.parquet(run.changes), ["bucket", "received_day"]))


@query
def stream_latest(spark, folder):
    run = replay(spark, folder, lambda s, r: st.start_changes(st.stream_latest(s), r.changes, r.checkpoint))
    return st.newest_rows(spark.read.parquet(run.changes), ["inst"]).select(*SAMPLE_COLUMNS)


@query
def stream_outbox(spark, folder):
    rules = fd.rules(spark)
    run = replay(
        spark, folder, lambda s, r: st.stream_outbox(st.stream_alerts(s, rules), rules, r.changes, r.checkpoint)
    )
    fields = "action string, delivery string, rule_id string, host string, pid bigint, triggered_at double, subject string"
    return spark.read.schema(fields).json(f"{run.changes}/outbox/*")

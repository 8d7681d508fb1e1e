"""Secret scan over an incremental ledger of text blobs, in DataFrame operations only.

Every text is addressed by its SHA-256, so equal versions are one blob however many paths
hold them. The ledger has a row per blob and rule version that was scanned. A scan looks
only at pairs the ledger lacks and then joins the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import fresh_name, written


@dataclass(frozen=True)
class Rule:
    """One kind of secret: leftmost non-overlapping matches whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


# The kinds and patterns of the base rules, in the order of the digest.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE_RULES + EXTRA_RULES
MASK = "[secret]"
RUN = 128
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in code points; null where the text has no match.

    The pieces between matches and the matches themselves alternate, so that the sums of
    their lengths are the positions.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    lengths = F.transform(whole, F.char_length)
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    # Sums of all that lies before a match, by runs of RUN matches: a text with many stays linear in practice.
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(lengths)), lengths, lambda b, n: b + n)
    one = F.array(F.struct(between.alias("between"), lengths.alias("lengths"), group.alias("group"), steps.alias("steps")))
    runs = lambda row: F.sequence(F.lit(0), F.floor((F.size(row["steps"]) - 1) / RUN).cast("int"))
    sums = F.transform(one, lambda row: F.struct(row.alias("row"), F.transform(runs(row), lambda r: total(F.slice(row["steps"], r * RUN + 1, F.lit(RUN)))).alias("sums")))
    before = F.transform(sums, lambda x: F.struct(x["row"].alias("row"), F.transform(runs(x["row"]), lambda r: total(F.slice(x["sums"], F.lit(1), r))).alias("before")))

    def span(x: Column, i: Column) -> Column:
        row, run = x["row"], F.floor(i / RUN).cast("int")
        start = F.element_at(x["before"], run + 1) + total(F.slice(row["steps"], run * RUN + 1, i - run * RUN)) + F.element_at(row["between"], i + 1)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + F.element_at(row["lengths"], i + 1)).alias("end"), F.char_length(F.element_at(row["group"], i + 1)).alias("size"))

    found = F.flatten(F.transform(before, lambda x: F.transform(F.sequence(F.lit(0), F.size(x["row"]["lengths"]) - 1), lambda i: span(x, i))))
    kept = F.filter(found, lambda s: s["size"] >= rule.least)
    plain = F.transform(kept, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))
    return F.when(F.regexp_like(text, pattern), plain)


def versions(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what ``ledger`` has not seen: (paths, ledger with the new pairs).

    ``paths`` has doc_id, blob and spans (sorted by start, then rule order) per row of
    ``docs``. A ledger row is blob, versions (the rule versions scanned) and spans (what
    they found). A null text is the empty blob. Rows that repeat are one blob and stay
    separate paths, with or without an id; other columns are ignored. Findings of rule
    versions that are no longer in ``rules`` stay in the ledger but not in ``paths``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))
    paths = written(source.select("doc_id", "blob"), "paths")
    wanted = versions(rules)
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("rep"))
    if ledger is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("versions")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0).select("blob", "rep", "todo")
    todo = todo.withColumnRenamed("blob", "_blob")
    unseen = source.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    found = [F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), rule_spans(F.col("text"), r, i)) for i, r in enumerate(rules)]
    scanned = unseen.select("blob", F.col("todo").alias("versions"), *[f.alias(f"_{i}") for i, f in enumerate(found)])
    none = F.array().cast(SPANS)
    spans = F.array_sort(F.concat(*[F.coalesce(F.col(f"_{i}"), none) for i in range(len(rules))]))
    fresh = written(scanned.select("blob", "versions", spans.alias("spans")).dropDuplicates(["blob"]), "ledger")
    whole = fresh if ledger is None else ledger.select("blob", "versions", "spans").unionByName(fresh)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    hits = whole.where(F.size("spans") > 0)
    if ledger is not None:
        hits = hits.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ranks = F.transform(F.col("spans"), lambda s: F.struct(s["start"].alias("start"), (F.array_position(kinds, s["kind"]).cast("int") - 1).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    current = hits.select("blob", F.array_sort(F.array_distinct(F.filter(ranks, lambda s: s["rank"] >= 0))).alias("spans"))
    joined = paths.join(current, "blob", "left")
    return joined.select("doc_id", "blob", F.coalesce("spans", none).alias("spans")), whole


def joined_spans(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span masked and n_chars brought up to date; columns unchanged.

    Spans that overlap are masked as one. Texts without findings, null and empty ones too,
    stay as they are, and so does every other column, whatever its name.
    """
    name = {part: fresh_name(docs, part) for part in ("blob", "spans", "masked")}
    paths, _ = scan(docs, None, rules)
    hits = paths.where(F.size("spans") > 0).select(F.col("blob").alias(name["blob"]), F.col("spans").alias(name["spans"])).dropDuplicates([name["blob"]])
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    marked = docs.join(hits.hint("shuffle_hash"), blob == F.col(name["blob"]), "left")

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], F.substr(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit(MASK))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(name["spans"], start, step, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1)))
    hit = F.col(name["spans"]).isNotNull()
    marked = marked.withColumn(name["masked"], F.when(hit, masked).otherwise(F.col("text")))
    columns = []
    for field in docs.schema:
        if field.name == "text":
            columns.append(F.col(name["masked"]).alias("text"))
        elif field.name == "n_chars":
            columns.append(F.when(hit, F.char_length(name["masked"]).cast(field.dataType)).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"`{field.name}`"))
    return marked.select(*columns)

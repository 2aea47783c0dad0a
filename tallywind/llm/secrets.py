"""Secret scans with corpus-wide ownership frequency.

Patterns propose candidates in every whole text. What a candidate is worth is decided over the corpus: its value is hashed
and counted by distinct repositories and distinct owners. A value that many owners hold, or that lies in very many repositories, is
a widely copied example; any other looks like a live credential of its owner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywind.llm.tables import land


@dataclass(frozen=True)
class Kind:
    """`value` is the group with the credential, at least `least` characters long; failing matches are dropped.

    `needs`: further patterns that the value must hold. Spans of an `extra` kind count only where they look live.
    """

    name: str
    pattern: str
    value: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    extra: bool = True


#: Matches of one part of a text's list, and characters of one block of a text that is cut.
PART, BLOCK = 256, 4096
#: In the order in which spans with one start are listed.
KINDS = (
    Kind(
        "assign",
        r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        value=1, least=8, extra=False,
    ),
    Kind("access", r"AKIA[A-Z0-9]+", least=16, extra=False),
    # Runs under 32 would fail; asking for 32 at once gives the same spans.
    Kind("hex", r"[0-9a-f]{32,}", least=32, extra=False),
    Kind("vendor", r"(?:gh[pousr]_|sk_live_|sk_test_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}", least=20),
    Kind("opaque", r"[A-Za-z0-9+/_-]{24,}", least=24, needs=("[a-z]", "[A-Z]", "[0-9].*[0-9]")),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: Kind, rank: int) -> Column:
    """`start, kind (rank), end, value` of the kind's matches in `text`, in code points from 0, end exclusive.

    The texts between matches are what `split` leaves, so places are sums of lengths.
    """
    pattern = _quoted(kind.pattern)
    value = "m" if kind.value == 0 else f"regexp_extract(m, {pattern}, {kind.value})"
    tests = " AND ".join([f"length(value) >= {kind.least}", *[f"value RLIKE {_quoted(p)}" for p in kind.needs]])
    # Arrays grow by copying, so running sums go part by part: first over the parts, then inside each.
    parts = f"sequence(0, greatest(0, (size(x) - 1) div {PART}))"
    part = f"slice(x, k * {PART} + 1, {PART})"
    return F.expr(
        f"""CASE WHEN text RLIKE {pattern} THEN transform(
            array(filter(zip_with(regexp_extract_all(text, {pattern}, 0), split(text, {pattern}), (m, gap) -> struct(m, length(gap) AS gap)), p -> p.m IS NOT NULL)),
            x -> transform(
                array(aggregate(
                    transform({parts}, k -> aggregate({part}, 0, (sum, y) -> sum + y.gap + length(y.m))),
                    cast(array(0) AS array<int>), (sums, y) -> concat(sums, array(element_at(sums, -1) + y)))),
                before -> filter(flatten(transform({parts}, k -> aggregate(
                    {part}, struct(before[k] AS past, cast(array() AS array<struct<start:int, kind:int, end:int, value:string>>) AS spans),
                    (a, y) -> struct(
                        a.past + y.gap + length(y.m) AS past,
                        concat(a.spans, array(struct(a.past + y.gap AS start, {rank} AS kind, a.past + y.gap + length(y.m) AS end,
                            transform(array(y.m), m -> {value})[0] AS value))) AS spans),
                    a -> a.spans))), s -> transform(array(s.value), value -> {tests})[0]))[0])[0]
            ELSE cast(array() AS array<struct<start:int, kind:int, end:int, value:string>>) END"""
    )


def candidates(documents: DataFrame, keep: list[str] | None = None, kinds: tuple[Kind, ...] = KINDS, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """`row, doc, owner, repository, spans` for every row, landed in the shared folder: texts are searched once.

    `doc` holds the columns named in `keep` (default: all). Null text counts as empty; null owners and repositories count as one
    owner, one repository.
    """
    keep = documents.columns if keep is None else keep
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*[documents[c] for c in keep]).alias("doc"),
        documents[owner].cast("string").alias("owner"), documents[repository].cast("string").alias("repository"),
        F.coalesce(documents["text"], F.lit("")).alias("text"),
    )
    spans = F.concat(*[_spans(k, i) for i, k in enumerate(kinds)])
    return land(rows.select("row", "doc", "owner", "repository", F.array_sort(spans).alias("spans")))


def values(found: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """`row, owner, repository, start, kind, end, hash` of all spans, landed, but for those of extra kinds that overlap one of the others."""
    extra = F.col("kind").isin([i for i, k in enumerate(kinds) if k.extra])
    spans = found.select("row", "owner", "repository", F.explode("spans").alias("s")).select(
        "row", "owner", "repository", "s.start", "s.kind", "s.end", F.sha2(F.col("s.value"), 256).alias("hash")
    )
    # Frames that end at the row are summed up as they grow; those that begin there would be read anew for each row.
    order = ["start", extra, "kind", "end"]
    upwards = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    downwards = Window.partitionBy("row").orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.when(~extra, F.col("end"))).over(upwards)
    after = F.min(F.when(~extra, F.col("start"))).over(downwards)
    spans = spans.withColumns({"until": until, "after": after})
    overlaps = F.coalesce(F.col("until") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False))
    return land(spans.filter(~extra | ~overlaps).drop("until", "after"))


def ownership(spans: DataFrame) -> DataFrame:
    """`hash, n_owners, n_repositories` of every candidate value in the corpus; null owners count as one, and null repositories.

    Counted in two steps, so that a value that a third of all rows hold is summed up before it is shuffled.
    """
    named = spans.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
    return named.groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repository").alias("n_repositories"))


def verdicts(found: DataFrame, kinds: tuple[Kind, ...] = KINDS, many_owners: int = 5, many_repositories: int = 100) -> DataFrame:
    """`row, start, kind, end, hash, n_owners, n_repositories, live` for each span that counts.

    `live`: fewer than `many_owners` owners hold the value, in fewer than `many_repositories` repositories. Spans of extra kinds
    count only if live.
    """
    spans = values(found, kinds)
    live = (F.col("n_owners") < many_owners) & (F.col("n_repositories") < many_repositories)
    judged = spans.drop("owner", "repository").join(ownership(spans), "hash").withColumn("live", live)
    extra = [i for i, k in enumerate(kinds) if k.extra]
    return judged.filter(F.col("live") | ~F.col("kind").isin(extra))


def digest(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """`kind:start:end` of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(documents: DataFrame, keep: list[str], kinds: tuple[Kind, ...] = KINDS, many_owners: int = 5, many_repositories: int = 100) -> DataFrame:
    """For every row: its columns in `keep`, `base` (spans of the base kinds) and `all_spans` (with the method's own).

    Null text counts as empty; repeated rows are scanned each for itself, and count as one repository where their `doc_id` is the
    same; an empty table gives no rows. Columns of `documents` may have any names. Time is in proportion to a text's length and matches.
    """
    found = candidates(documents, keep, kinds)
    spans = verdicts(found, kinds, many_owners, many_repositories).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("all_spans")
    )
    extra = [i for i, k in enumerate(kinds) if k.extra]
    base = F.filter("spans", lambda s: ~s["kind"].isin(extra))
    return found.join(spans, "row", "left").select(
        "doc.*", base.alias("base"),
        F.coalesce("all_spans", F.expr("cast(array() AS array<struct<start:int, kind:int, end:int, live:boolean>>)")).alias("all_spans"),
    )


def _cuts(spans: DataFrame) -> DataFrame:
    """`row, cuts`: by block of the text, the places inside it that go, and whether they begin there; overlapping spans are one."""
    order = Window.partitionBy("row").orderBy("start", "end")
    until = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.select("row", "start", "end").withColumn("fresh", F.coalesce(F.col("start") > until, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    blocks = whole.withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}, (end - 1) div {BLOCK})")))
    local = blocks.select(
        "row", "block", F.expr(f"cast(greatest(start - block * {BLOCK}, 0) AS int)").alias("from"),
        F.expr(f"cast(least(end - block * {BLOCK}, {BLOCK}) AS int)").alias("to"), F.expr(f"start div {BLOCK} = block").alias("head"),
    )
    by_block = local.groupBy("row", "block").agg(F.array_sort(F.collect_list(F.struct("from", "to", "head"))).alias("cuts"))
    return by_block.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("block").cast("int"), "cuts"))).alias("cuts"))


def redact(
    documents: DataFrame, mask: str = "[SECRET]", kinds: tuple[Kind, ...] = KINDS, many_owners: int = 5, many_repositories: int = 100
) -> DataFrame:
    """`documents` with every live-looking span replaced by `mask`; overlapping spans give one mask.

    All rows and columns stay, repeated rows too; widely copied examples stay readable. Null text stays null, an empty table stays
    empty. Texts are cut block by block, so that a text with very many spans is not walked through for each of them.
    """
    found = candidates(documents, None, kinds)
    live = verdicts(found, kinds, many_owners, many_repositories).filter("live")
    rows = found.join(_cuts(live), "row", "left")
    clean = F.expr(
        f"""array_join(transform(sequence(0, (length(doc.text) - 1) div {BLOCK}), k -> transform(
            array(struct(substring(doc.text, k * {BLOCK} + 1, {BLOCK}) AS text, coalesce(try_element_at(cuts, k), array()) AS cuts)),
            b -> array_join(transform(sequence(0, size(b.cuts)), j -> concat(
                CASE WHEN j > 0 AND b.cuts[j - 1].head THEN {_quoted(mask)} ELSE '' END,
                substring(b.text, CASE WHEN j = 0 THEN 1 ELSE b.cuts[j - 1].to + 1 END,
                    (CASE WHEN j = size(b.cuts) THEN {BLOCK} ELSE b.cuts[j].from END) - (CASE WHEN j = 0 THEN 0 ELSE b.cuts[j - 1].to END)))), ''))[0]), '')"""
    )
    text = F.when(F.col("cuts").isNull(), F.col("doc.text")).otherwise(clean)
    return rows.select(*[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in documents.columns])

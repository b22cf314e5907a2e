"""Operator 9: homomorphic multiset hash of a text's paragraphs, DataFrame functions only.

Lines, cut further at sentence ends, are the members of a multiset. Each member's SHA-256 gives a wide vector; the
fingerprint is the sum of the vectors: a count, 8 lanes modulo 2^32 and 64 sign counts modulo 2^16. The order of members does
not matter, adding or taking out a member adds or subtracts its vector, and equal multisets have equal fingerprints.
The sign counts are a tug-of-war sketch: the dot product of two texts' signs estimates how many members they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import text_or_empty
from featsieve.functions import local_table

STRONG, SIGNS = 8, 32  # strong lanes of 32 bits; packed sign lanes, two counts in each
BUCKET_DOCS, MAX_BUCKETS = 256, 100_000


def members(text: Column) -> Column:
    """Paragraphs of a text; a sentence end before a space counts as a line end. The empty text has one empty member."""
    return F.split(F.regexp_replace(text, "([.!?]) ", "$1\n"), "\n", -1)


def _lane_columns(member: Column) -> list[Column]:
    digest = F.sha2(member, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_l{i}") for i in range(STRONG)]


def _sums() -> list[Column]:
    wide = [F.sum(f"_l{i}").alias(f"_s{i}") for i in range(STRONG)]
    bits = F.col("_l0") + F.shiftleft("_l1", 32)
    both = F.lit((1 << 32) + 1)
    signs = [F.sum(F.shiftrightunsigned(bits, s).bitwiseAND(both)).alias(f"_g{s}") for s in range(SIGNS)]
    return [F.count(F.lit(1)).alias("_n"), *wide, *signs]


def _packed() -> Column:
    """The sums as one array: count, strong lanes, packed sign counts."""
    return F.array("_n", *[F.col(f"_s{i}") for i in range(STRONG)], *[F.col(f"_g{s}") for s in range(SIGNS)])


def _hex(value: Column, bits: int) -> Column:
    return F.lpad(F.lower(F.hex(value.bitwiseAND(F.lit((1 << bits) - 1)))), bits // 4, "0")


def fingerprint_text(sums: Column) -> Column:
    """Fixed-width hexadecimal form of the sums, each lane modulo its power of two."""
    signs = [x for s in range(SIGNS) for x in (_hex(sums[1 + STRONG + s], 16), _hex(F.shiftrightunsigned(sums[1 + STRONG + s], 32), 16))]
    return F.concat(_hex(sums[0], 32), *[_hex(sums[1 + i], 32) for i in range(STRONG)], *signs)


def _signs(sums: Column) -> Column:
    """The 64 sums of +1 and -1."""
    packed = F.slice(sums, 2 + STRONG, SIGNS)
    low = F.transform(packed, lambda x: 2 * x.bitwiseAND(F.lit((1 << 32) - 1)) - sums[0])
    high = F.transform(packed, lambda x: 2 * F.shiftrightunsigned(x, 32) - sums[0])
    return F.concat(low, high)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of members two sums have in common, 0 to 1: twice the dot product over both squared norms."""
    whole = _dot(_signs(a), _signs(a)) + _dot(_signs(b), _signs(b))
    share = (2 * _dot(_signs(a), _signs(b))).cast("double") / F.when(whole > 0, whole).cast("double")
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(0.0)))


def insert_members(sums: Column, more: Column) -> Column:
    """Sums of a text after members whose sums are ``more`` came in."""
    return F.zip_with(sums, more, lambda x, y: x + y)


def delete_members(sums: Column, gone: Column) -> Column:
    """Sums of a text after members whose sums are ``gone`` were taken out."""
    return F.zip_with(sums, gone, lambda x, y: x - y)


def text_sums(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sums of the members of ``text`` per ``keys``: (keys, sums)."""
    exploded = df.select(*keys, F.explode(members(F.col(text))).alias("_member")).select(*keys, *_lane_columns(F.col("_member")))
    return exploded.groupBy(*keys).agg(*_sums()).select(*keys, _packed().alias("sums"))


def _share(of: Column, low: Column, width: Column, parts: Column) -> Column:
    """Which of ``parts`` equal ranges from ``low`` on holds ``of``; differences are exact, so it never falls as ``of`` grows."""
    past = (of.cast("decimal(20,0)") - low.cast("decimal(20,0)")).cast("double")
    return F.least(parts - 1, F.floor(past / width).cast("int"))


def _cut(rows: DataFrame, low: int | None, bucket_docs: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Rows with ``_cell``, and (least _key, least _tie, cell) of the cells in ascending order.

    A cell with too many rows is cut again into equal ranges of its own ids, one that holds a single id into ranges of
    the text hash, and one that holds copies of a row by row number, so neither an outlier nor a shared id fills a task.
    """
    keyed = rows.withColumn("_key", F.coalesce("doc_id", F.lit(0 if low is None else low))).withColumn("_tie", F.xxhash64("text"))
    # the first cell is no constant to the planner, or the joins by cell would be nested loops
    keyed = keyed.withColumn("_spread", F.monotonically_increasing_id()).withColumn("_cell", F.least(F.col("_spread"), F.lit(0)).cast("int"))
    facts = [F.count(F.lit(1)).alias("n"), F.min(F.struct("_key", "_tie")).alias("first"), F.max("_key").alias("high"), F.min("_tie").alias("low_tie"), F.max("_tie").alias("high_tie")]
    used, dealt, size = 1, set(), 0
    while True:
        cells = keyed.groupBy("_cell").agg(*facts).collect()  # one row per filled cell: MAX_BUCKETS and a few for each level
        size = size or max(bucket_docs, -(-sum(c["n"] for c in cells) // MAX_BUCKETS))
        cuts = []
        for c in cells:
            if c["n"] <= 4 * size or c["_cell"] in dealt:
                continue
            parts = -(-c["n"] // size)
            kind, start, end = 0, c["first"]["_key"], c["high"]
            if start == end:
                kind, start, end = 1, c["low_tie"], c["high_tie"]
            if start == end:
                kind, start, end = 2, 0, parts
                dealt.update(range(used, used + parts))
            cuts.append((c["_cell"], kind, start, (end - start) / parts, parts, used))
            used += parts
        if not cuts:
            return keyed, sorted((c["first"]["_key"], c["first"]["_tie"], c["_cell"]) for c in cells)
        plan = F.broadcast(local_table(rows.sparkSession, cuts, "_cell int, _kind int, _low long, _width double, _parts int, _new int"))
        cut = F.col("_low"), F.col("_width"), F.col("_parts")
        part = F.when(F.col("_kind") == 0, _share(F.col("_key"), *cut)).when(F.col("_kind") == 1, _share(F.col("_tie"), *cut)).otherwise(F.pmod("_spread", "_parts").cast("int"))
        keyed = keyed.join(plan, "_cell", "left").withColumn("_cell", F.coalesce(F.col("_new") + part, "_cell")).select(*keyed.columns)


def _neighbours(rows: DataFrame, bucket_docs: int) -> DataFrame:
    """Rows dealt to buckets of (doc_id, text hash) ranges; each bucket also holds the first rows of the next filled one (``_guest``)."""
    keyed, firsts = _cut(rows, rows.agg(F.min("doc_id")).first()[0], bucket_docs)
    before = [(cell, key, tie, firsts[i - 1][2]) for i, (key, tie, cell) in enumerate(firsts)]
    marks = local_table(rows.sparkSession, before, "_cell int, _first long, _first_tie long, _before int")
    marked = keyed.join(F.broadcast(marks), "_cell")
    own = F.struct(F.col("_cell").alias("b"), F.lit(0).alias("g"))
    guest = F.struct(F.col("_before").alias("b"), F.lit(1).alias("g"))
    leads = (F.col("_key") == F.col("_first")) & (F.col("_tie") == F.col("_first_tie"))
    places = F.when(leads, F.array(own, guest)).otherwise(F.array(own))
    return marked.withColumn("_place", F.explode(places)).select("doc_id", "text", "_key", "_tie", F.col("_place.b").alias("_bucket"), F.col("_place.g").alias("_guest"))


def fingerprint_documents(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (its last quarter replaced by the next document's head).

    Null texts are empty; rows with null doc_id stand with the smallest id; rows of one doc_id are ordered by a hash of
    their text, so copies follow one another; the document after the last is the first, so a single document follows
    itself; an empty table gives no rows; other columns are not read, whatever their names. Texts are shuffled once, by
    bucket; windows and sums then stay inside a bucket, which holds about ``bucket_docs`` rows however ids are spread.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = Window.partitionBy("_bucket").orderBy("_guest", "_key", "_tie", "text", "doc_id")
    placed = _neighbours(rows, bucket_docs).withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit(""))).withColumn("_row", F.row_number().over(order))
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut))
    placed = placed.withColumn("_edited", edited).withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2("_edited", 256))
    keys = ["_bucket", "_guest", "_row", "doc_id", "n_chars", "edited_sha256"]
    versions = F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("_edited").alias("t"))))
    sums = text_sums(placed.select(*keys, versions.alias("_version")).select(*keys, F.col("_version.v").alias("_v"), F.col("_version.t").alias("_t")), [*keys, "_v"], "_t")
    both = sums.groupBy(*keys).agg(F.max(F.when(F.col("_v") == 0, F.col("sums"))).alias("_own"), F.max(F.when(F.col("_v") == 1, F.col("sums"))).alias("_changed"))
    both = both.withColumn("_follows", F.lead("_own").over(Window.partitionBy("_bucket").orderBy("_row"))).filter("_guest = 0")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("_own")).alias("fingerprint"), fingerprint_text(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"), likeness(F.col("_own"), F.col("_follows")).alias("near_next"))


def op9_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _twin() -> str:
    """The query in DuckDB SQL; sums and sign lanes are spelled out by lane."""
    def value(i: int) -> str:
        return f"('0x' || substr(d, {8 * i + 1}, 8))::BIGINT"

    lanes = ", ".join(f"{value(i)} AS l{i}" for i in range(STRONG))
    strong = ", ".join(f"sum(l{i})::HUGEINT AS s{i}" for i in range(STRONG))
    low = [f"sum((l0 >> {s}) & 1)::BIGINT AS a{s}" for s in range(SIGNS)]
    high = [f"sum((l1 >> {s}) & 1)::BIGINT AS b{s}" for s in range(SIGNS)]
    form = " || ".join(
        ["printf('%08x', n)", *[f"printf('%08x', (s{i} % 4294967296)::BIGINT)" for i in range(STRONG)],
         *[f"printf('%04x', {c}{s} % 65536)" for s in range(SIGNS) for c in "ab"]])
    signs = "[" + ", ".join(f"2 * {c}{s} - n" for c in "ab" for s in range(SIGNS)) + "]"

    def like(a: str, b: str) -> str:
        dot = lambda x, y: f"list_sum(list_transform(list_zip({x}.g, {y}.g), lambda p: p[1] * p[2]))::BIGINT"
        whole = f"({dot(a, a)} + {dot(b, b)})"
        return f"CASE WHEN {a}.f = {b}.f THEN 1.0::DOUBLE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (2 * {dot(a, b)})::DOUBLE / {whole}::DOUBLE)) END"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n_chars,
                  row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS total FROM documents),
e AS (SELECT a.doc_id, a.r, a.n_chars, a.t, substr(a.t, 1, a.n_chars - a.n_chars // 4) || substr(b.t, 1, a.n_chars // 4) AS x, b.r AS next_r
      FROM d a JOIN d b ON b.r = a.r % a.total + 1),
v AS (SELECT r, 0 AS v, t FROM e UNION ALL SELECT r, 1, x FROM e),
u AS (SELECT r, v, sha256(unnest(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)))) AS d FROM v),
l AS (SELECT r, v, {lanes} FROM u),
s AS (SELECT r, v, count(*) AS n, {strong}, {", ".join(low)}, {", ".join(high)} FROM l GROUP BY r, v),
f AS (SELECT r, v, {form} AS f, {signs} AS g FROM s)
SELECT e.doc_id, e.n_chars, sha256(e.x) AS edited_sha256, own.f AS fingerprint, changed.f AS edited_fingerprint,
       {like("own", "changed")} AS near_edited, {like("own", "following")} AS near_next
FROM e JOIN f own ON own.r = e.r AND own.v = 0 JOIN f changed ON changed.r = e.r AND changed.v = 1
       JOIN f following ON following.r = e.next_r AND following.v = 0"""


TWIN = _twin()

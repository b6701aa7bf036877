"""Document fingerprints by winnowing, in DataFrame functions only.

A text (in lower case) is cut into units that depend on what is around them alone: a run of up to 24 letters with the
plain mark or digit after it, and each character for itself in longer runs (up to their last 24 letters), in scripts that
do without spaces, and among marks and digits. So texts without white space have as many grams as others. A gram of ``GRAM`` = 5 units has the cyclic
polynomial hash of its units' hashes, the hash that rolls on by one rotation and two exclusive-ors. For columns of
arrays it is made by doubling: the hash of two units from two of one, of four from two of two, of five from four and
one. Of every ``WINDOW`` = 8 grams in a row the smallest hash is chosen, the rightmost of equals, by doubling too, and
kept with its position. So any 12 units that two texts share give a common selection (WINDOW + GRAM - 1), and no match
of fewer than 5 units is reported. Hashes have 61 bits: the lowest three of 64 make room for the place in the window.

The next document of each comes by a window over ranges of doc_ids, each with the first row of the range after it.
There are about ``RANGES`` ranges at most, whose bounds, two numbers each, are all that the driver gets.

Defined cases: null text is empty; a text of fewer than 5 units is one gram, of none has an empty selection (alike, 1.0,
to another empty one only); equal doc_ids follow by the hash of their text, then by text, rows without id come first;
the last document's next is the first, a sole document's is itself; repeated rows are rows each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import texts

GRAM, WINDOW, TURN = 5, 8, 13
#: Letters of scripts with spaces (Latin to Sinhala, Georgian to Philippine, Mongolian to Greek), in lower case.
LETTER = r"[a-z\x{C0}-\x{DFF}\x{10A0}-\x{177F}\x{1800}-\x{1FFF}]"
UNIT = rf"{LETTER}{{1,24}}+(?!{LETTER})[!-`{{-~]?|\S"
#: Rows of a range of doc_ids, within which the next document is found, and ranges at most, both on average.
RANGE_ROWS, RANGES = 1000, 65_536


def _turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by % 64).bitwiseOR(F.shiftrightunsigned(x, 64 - by % 64))


def _after(c: str, n: int) -> Column:
    """The array without its first ``n`` elements."""
    return F.slice(F.col(c), F.lit(n + 1), F.greatest(F.size(c) - n, F.lit(0)))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the winnowed selection of a text column: a struct of positions (in units, from 0) and hashes, two arrays in order.

    Each step is a column of its own and is read twice in the next, so that no step is evaluated anew for each element.
    """
    steps = [f"__{k}_{out}" for k in range(8)]
    one, two, four, gram, w2, w4, w8, n = steps
    hashes = F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    # a text of fewer units has zeros in the place of the missing ones
    padded = lambda x: F.when(F.size(x).between(1, GRAM - 1), F.concat(x, F.array_repeat(F.lit(0).cast("long"), GRAM - 1))).otherwise(x)
    df = df.withColumn(n, hashes).withColumns({one: padded(F.col(n)), n: F.size(n)})
    rolled = lambda by: lambda a, b: _turned(a, by).bitwiseXOR(b)
    df = df.withColumn(two, F.zip_with(F.col(one), _after(one, 1), rolled(TURN)))
    df = df.withColumn(four, F.zip_with(F.col(two), _after(two, 2), rolled(2 * TURN)))
    grams = F.greatest(F.col(n) - (GRAM - 1), F.least(F.col(n), F.lit(1)))
    # the lowest bits: 7 less the place in the window, so that the rightmost of equals is the smallest
    place = lambda a, b: _turned(a, TURN).bitwiseXOR(b).bitwiseOR(F.lit(WINDOW - 1).cast("long"))
    df = df.withColumn(gram, F.slice(F.zip_with(F.col(four), _after(one, 4), place), F.lit(1), grams))
    lower = lambda by: lambda a, b: F.least(a, b - by)
    for wide, narrow, by in ((w2, gram, 1), (w4, w2, 2), (w8, w4, 4)):
        df = df.withColumn(wide, F.zip_with(F.col(narrow), _after(narrow, by), lower(by)))
    windows = F.greatest(F.size(w8) - (WINDOW - 1), F.least(F.size(w8), F.lit(1)))
    at = lambda v, j: j + (F.lit(WINDOW - 1) - v.bitwiseAND(F.lit(WINDOW - 1).cast("long"))).cast("int")
    # a window that chooses what the one before it chose has it one place further left
    chosen = F.transform(F.slice(w8, F.lit(1), windows), lambda v, j: F.when((j > 0) & (v == F.get(F.col(w8), j - 1) + 1), F.lit(None)).otherwise(F.struct(at(v, j).alias("position"), F.shiftrightunsigned(v, 3).alias("hash"))))
    df = df.withColumn(gram, F.array_compact(chosen))
    return df.withColumn(out, F.struct(F.col(gram).getField("position").alias("positions"), F.col(gram).getField("hash").alias("hashes"))).drop(*steps)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the hashes of two selections; two empty ones are alike."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, positions and hashes of the selection of every text."""
    return with_fingerprint(texts(docs), "text", "__f").select("doc_id", "__f.*")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of doc_id, text and its hash, in ranges, ready for ``lead``: adds range, guest.

    The first row of each range is also a guest at the end of the range before. Ranges begin at the least row and at
    those whose own hash is a multiple of the rows wanted in a range, so that reruns cut alike; equal ids, or none,
    spread over ranges by the hash of their text.
    """
    rows = texts(docs).withColumns({"doc_id": F.coalesce("doc_id", F.lit(-(2**63))), "h": F.xxhash64("text")})
    ids = rows.select("doc_id", "h")
    n, least = ids.agg(F.count("*"), F.min(F.struct("doc_id", "h"))).first()
    each = max(RANGE_ROWS, math.ceil(n / RANGES))
    cuts = ids.filter(F.pmod(F.xxhash64("doc_id", "h"), F.lit(each)) == 0).distinct().collect()
    lows = sorted({tuple(r) for r in cuts} | ({tuple(least)} if least else set()))
    width = max(1, math.isqrt(len(lows)))
    blocks = [lows[i : i + width] for i in range(0, len(lows), width)] or [[(0, 0)]]
    me = F.struct("doc_id", "h")

    def upto(array: Column) -> Column:
        return F.greatest(F.size(F.filter(array, lambda low: low <= me)) - 1, F.lit(0))

    bound = "struct<doc_id:bigint,h:bigint>"
    shown = lambda b: dict(zip(("doc_id", "h"), b, strict=True))
    literal = F.from_json(F.lit(json.dumps([[shown(b) for b in block] for block in blocks])), f"array<array<{bound}>>")
    tops = F.from_json(F.lit(json.dumps([shown(b[0]) for b in blocks])), f"array<{bound}>")
    placed = rows.withColumn("__block", upto(tops)).withColumn("__lows", F.get(literal, F.col("__block")))
    placed = placed.withColumn("__at", upto(F.col("__lows"))).withColumn("range", F.col("__block") * width + F.col("__at"))
    first = me == F.get(F.col("__lows"), F.col("__at"))
    before = F.pmod(F.col("range") - 1, F.lit(max(1, len(lows))))
    own, guest = (F.struct(r.cast("int").alias("range"), F.lit(g).alias("guest")) for r, g in ((F.col("range"), False), (before, True)))
    return placed.select("doc_id", "h", "text", F.inline(F.when(first, F.array(own, guest)).otherwise(F.array(own))))


def compared(docs: DataFrame) -> DataFrame:
    """Per document: its selection, that of its edited text, and how alike they and the next document's are."""
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "h", "text")
    rows = with_fingerprint(with_next(docs), "text", "fp")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_hashes": F.lead("fp.hashes").over(order)}).filter("not guest")
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumns({"n_chars": chars.cast("long"), "edited": edited}).drop("text", "next_text")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_fingerprint(rows, "edited", "edited_fp")
    doc_id = F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id")
    return rows.select(doc_id, "n_chars", "edited_sha256", "fp", "edited_fp", likeness(F.col("fp.hashes"), F.col("edited_fp.hashes")).alias("near_edited"), likeness(F.col("fp.hashes"), F.col("next_hashes")).alias("near_next"))


def shown(selected: Column) -> Column:
    """A selection as text: position:hash (hexadecimal), with commas between."""
    return F.array_join(F.zip_with(selected.positions, selected.hashes, lambda p, h: F.concat_ws(":", p, F.hex(h))), ",")


def shown_comparison(docs: DataFrame) -> DataFrame:
    """``compared`` with selections as text."""
    return compared(docs).select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.size("fp.hashes").cast("long").alias("n_selected"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_comparison(spark.read.parquet(f"{sf_dir}/documents.parquet"))

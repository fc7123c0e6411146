"""Document fingerprints by winnowing, with built-in functions only.

All k-grams of code points are hashed; of every window of consecutive hashes the smallest is
chosen, the rightmost of equal ones.  Any passage of ``K + W - 1`` code points that two texts
share puts at least one common hash into both fingerprints; passages shorter than ``K`` never
match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotscope.llm.common import bound

K = 16
#: Hashes of a window, a power of two.
W = 32
#: Code points of a window.
SPAN = K + W - 1
#: Of a hash, the bits that are compared; the rest of a key is the position.
COMPARED = ((1 << 31) - 1) << 32
LOW = (1 << 32) - 1
FOUND = "array<struct<position: int, hash: bigint>>"
#: Rows of a range of documents that are neighbours, and ranges at most.
RANGE_ROWS, RANGES = 64, 1 << 16


def _key(found_hash: Column, place: Column) -> Column:
    """Smaller hashes have smaller keys; of equal ones the larger place (from 1) has."""
    return found_hash.bitwiseAND(F.lit(COMPARED)) - place


def _place(key: Column) -> Column:
    return (F.lit(LOW + 1) - key.bitwiseAND(F.lit(LOW))).cast("int")


def _minima(keys: Column) -> Column:
    """The smallest key of every window of ``W`` keys, the width doubled step by step.  Fewer
    keys are one window."""
    now, width = keys, 1
    while width < W:
        now = bound(now, lambda a: F.zip_with(a, F.slice(a, width + 1, F.size(a)), lambda x, y: F.least(x, y)))  # noqa: B023
        width *= 2
    # The last windows reach over the end.
    return bound(now, lambda a: F.slice(a, 1, F.greatest(F.size(a) - W + 1, F.lit(1))))


def fingerprint(text: Column) -> Column:
    """array<struct<position, hash>>, ascending by position (code points, from 0).

    Texts shorter than ``K`` have one entry for all of it, empty and null ones none.
    """

    def chosen(code: Column) -> Column:
        gram = lambda at: F.xxhash64(F.substring(code, at, F.lit(4 * K)))
        # A code point has four bytes; places are those of bytes.
        places = F.sequence(F.lit(1), F.greatest(F.octet_length(code) - 4 * K + 1, F.lit(1)), F.lit(4))
        keys = F.transform(places, lambda at: _key(gram(at), at))
        selected = F.transform(F.array_distinct(_minima(keys)), _place)
        return F.transform(
            selected, lambda at: F.struct(F.shiftright(at, 2).alias("position"), gram(at).alias("hash"))
        )

    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    none = F.expr(f"cast(array() as {FOUND})")
    return F.when(empty, none).otherwise(bound(F.encode(text, "UTF-32"), chosen))


def _first_windows(found: Column, length: Column) -> Column:
    """Of a text's fingerprint, what the windows in its first ``length`` code points chose.

    The last of these windows chose the smallest key in it, and earlier ones nothing beyond.
    """
    start = length - SPAN
    key = lambda f: _key(f["hash"], f["position"] * 4 + 1)
    inside = F.filter(found, lambda f: (f["position"] >= start) & (f["position"] < start + W))
    last = F.shiftright(_place(F.array_min(F.transform(inside, key))), 2)
    none = F.expr(f"cast(array() as {FOUND})")
    return F.when(length < SPAN, none).otherwise(
        bound(last, lambda end: F.filter(found, lambda f: f["position"] <= end))
    )


def _moved(found: Column, by: Column, beyond: Column) -> Column:
    """Entries moved by so many positions, those up to ``beyond`` left out."""
    moved = F.transform(found, lambda f: F.struct((f["position"] + by).cast("int").alias("position"), f["hash"].alias("hash")))
    return F.filter(moved, lambda f: f["position"] > beyond)


def _last(found: Column, otherwise: Column) -> Column:
    return F.when(F.size(found) > 0, F.element_at(found, -1)["position"]).otherwise(otherwise)


def spliced(joined: Column, a: Column, kept: Column, b: Column, used: Column) -> Column:
    """The fingerprint of ``joined``, which is the first ``kept`` code points of a text with
    the fingerprint ``a`` and the first ``used`` of one with ``b``.

    Only the windows across the seam are hashed anew; it equals ``fingerprint(joined)``.
    """
    start = F.greatest(kept - SPAN + 1, F.lit(0))
    seam = F.substr(joined, start + 1, kept + SPAN - 1 - start)
    across = F.when((used > 0) | (kept < SPAN), fingerprint(seam)).otherwise(F.expr(f"cast(array() as {FOUND})"))

    def put(head: Column) -> Column:
        middle = _moved(across, start, _last(head, F.lit(-1)))
        return bound(middle, lambda m: F.concat(head, m, _moved(_first_windows(b, used), kept, _last(m, kept - 1))))

    return bound(_first_windows(a, kept), put)


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct hashes of two arrays that are in both; 1 for two empty ones."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def hashes(found: Column) -> Column:
    return F.transform(found, lambda f: f["hash"])


def rendered(found: Column) -> Column:
    """The first 32 bits of every hash, in hex, in order of position."""
    return F.array_join(F.transform(found, lambda f: F.lpad(F.hex(F.shiftrightunsigned(f["hash"], 32)), 8, "0")), "")


def ranges(docs: DataFrame) -> list[int]:
    """Ids that part the documents into ranges of about ``RANGE_ROWS`` rows, ascending, the
    smallest first.  At most ``RANGES``, so that the list stays small at any size."""
    rows, least = docs.agg(F.count("doc_id"), F.min("doc_id")).first()
    if not rows:
        return []
    n = min(RANGES, max(1, rows // RANGE_ROWS))
    points = [i / n for i in range(1, n)]
    cut = docs.agg(F.percentile_approx("doc_id", points, 2 * RANGES)).first()[0] if points else []
    return sorted({least, *cut})


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``found`` (fingerprint) of each row, with ``next_text`` and
    ``next_found`` of the row that follows by doc_id, after the last of the first.

    Rows are dealt to ranges of ids.  The first row of a range is dealt to the range before
    as well, where it ends the list; so each text is moved once.  Rows of one id are ordered
    by text; a null id comes first and counts as smaller than all.
    """
    cut = ranges(docs)
    firsts = F.array(*map(F.lit, cut)) if cut else F.expr("cast(array() as array<bigint>)")
    # Two steps: which stretch of ranges, then which range of it.
    stretch = 256
    heads = F.array(*map(F.lit, cut[::stretch])) if cut else firsts
    group = F.greatest(F.size(F.filter(heads, lambda x: x <= F.col("doc_id"))) - 1, F.lit(0))
    inner = F.size(F.filter(F.slice(firsts, group * stretch + 1, F.lit(stretch)), lambda x: x <= F.col("doc_id")))
    here = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.greatest(group * stretch + inner - 1, F.lit(0)))
    n = max(1, len(cut))
    leads = F.col("doc_id").isNull() | F.array_contains(F.slice(firsts, F.col("here") + 1, F.lit(1)), F.col("doc_id"))
    own = F.struct(F.col("here").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("here") - 1, F.lit(n)).alias("range"), F.lit(True).alias("guest"))
    dealt = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("here", here)
        .select("doc_id", "text", F.explode(F.when(leads, F.array(own, guest)).otherwise(F.array(own))).alias("to"))
        .select("doc_id", "text", "to.range", "to.guest").repartition("range")
        .withColumn("found", fingerprint(F.col("text")))
    )
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return (
        dealt.select("*", F.lead("text").over(order).alias("next_text"), F.lead("found").over(order).alias("next_found"))
        .filter(~F.col("guest")).drop("range", "guest")
    )


def op1_winnowing(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): its fingerprint, that of
    its text with the last half replaced from the next document, and how alike they are.

    Null texts count as empty.  A table of one row is its own next; no rows give no rows.
    """
    n = F.length("text")
    # Lengths are columns of their own: inside an array function they would be counted anew
    # for every element.
    made = with_next(docs).withColumn("n_chars", n.cast("long"))
    made = made.withColumns({
        "kept": (n - F.shiftright(n, 1)), "used": F.least(F.shiftright(n, 1), F.length("next_text")),
    })
    edited = F.concat(F.substr("text", F.lit(1), F.col("kept")), F.substr("next_text", F.lit(1), F.col("used")))
    made = made.withColumn("edited", edited).withColumn(
        "edited_found", spliced(F.col("edited"), F.col("found"), F.col("kept"), F.col("next_found"), F.col("used"))
    )
    own, other, following = (hashes(F.col(c)) for c in ("found", "edited_found", "next_found"))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        rendered(F.col("found")).alias("fingerprint"), rendered(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, following).alias("near_next"),
    )

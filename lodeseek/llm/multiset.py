"""Fingerprints of documents as sums of wide vectors hashed from their paragraphs, in DataFrame functions only.

A fingerprint is an array of longs that are cut into lanes. In the first EXACT two lanes of 31 bits sum hashes of the
paragraphs (lines) modulo 2**31: equal for equal multisets of paragraphs, whatever their order. The next one counts clauses. In the
rest four lanes of 15 bits, COMPONENTS in all, sum the bits of hashes of a paragraph's clauses modulo 2**15. As
every lane is a sum, paragraphs can be put in or taken out without the others (insert, delete), and two fingerprints tell how
alike two texts are: 2 * lane - clauses is a sum of random signs, whose products estimate how many clauses the texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions

EXACT = 4
COMPONENTS = 128
_LONGS = COMPONENTS // 4
#: Lanes of 31 bits in slots of 32, and of 15 in slots of 16: all bits but the lane's highest, and the highest.
_WIDE = (0x3FFFFFFF3FFFFFFF, 0x4000000040000000)
_SLIM = (0x3FFF3FFF3FFF3FFF, 0x4000400040004000)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _plus(a: Column, b: Column, lanes: tuple[int, int]) -> Column:
    """Sum lane by lane: no carry leaves a slot, and none reaches the sign."""
    low, high = map(_long, lanes)
    return (a.bitwiseAND(low) + b.bitwiseAND(low)).bitwiseXOR(a.bitwiseXOR(b).bitwiseAND(high))


def _minus(a: Column, b: Column, lanes: tuple[int, int]) -> Column:
    low, high = lanes
    one = sum(1 << k for k in range(0, 64, 32 if lanes is _WIDE else 16))
    return _plus(a, _plus(F.bitwise_not(b).bitwiseAND(_long(low | high)), _long(one), lanes), lanes)


def _combined(a: Column, b: Column, how) -> Column:
    numbered = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.zip_with(numbered, b, lambda p, q: F.when(p["i"] <= EXACT, how(p["x"], q, _WIDE)).otherwise(how(p["x"], q, _SLIM)))


def insert(whole: Column, part: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return _combined(whole, part, _plus)


def delete(whole: Column, part: Column) -> Column:
    """The fingerprint of whole without the paragraphs of part, which must be among its own."""
    return _combined(whole, part, _minus)


def fingerprints(rows: DataFrame, keys: list[str], text: str, copies: bool = False) -> DataFrame:
    """(keys, fp array<long>): a fingerprint for each key, of the paragraphs of all its texts. copies: the rows of a key have one and the same text, which counts once.

    Paragraphs are cut and hashed as rows and summed inside tasks first, one row a key and task; rows already dealt out by the
    keys, or some of them, move no more. A null text is empty: one empty paragraph without clauses.
    """
    lines = rows.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")).alias("_l", "_p"))
    parts = lines.select(*keys, "_l", "_p", F.posexplode(F.split("_p", "[.,;:!?]")).alias("_i", "_c")).withColumn("_c", F.btrim("_c", F.lit(" \t\r\x0b\x0c")))
    whole = [F.when(F.col("_i") == 0, F.xxhash64(F.lit(k), "_p")).otherwise(_long(0)).alias(f"_e{k}") for k in range(EXACT)]
    signs = [F.when(F.col("_c") != "", F.xxhash64(F.lit(EXACT + k), "_c")).otherwise(_long(0)).alias(f"_s{k}") for k in range(2)]
    hashed = parts.select(*keys, *whole, *signs, (F.col("_c") != "").cast("long").alias("_one"), ((F.col("_l") == 0) & (F.col("_i") == 0)).cast("long").alias("_n"))
    masked = lambda c, shift, mask: F.shiftrightunsigned(c, shift).bitwiseAND(_long(mask))
    sums = [F.sum(masked(f"_e{k}", 31 * half, 0x7FFFFFFF)).alias(f"_e{k}{half}") for k in range(EXACT) for half in range(2)]
    sums += [F.sum(masked(f"_s{k}", j, 0x100000001)).alias(f"_s{k}{j}") for k in range(2) for j in range(_LONGS)]
    summed = hashed.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_one").alias("_one"), *sums)
    if copies:
        summed = summed.select(*keys, *[F.expr(f"{c} div _n").alias(c) for c in summed.columns[len(keys) + 1 :]])

    def lane(c: str, shift: int, mask: int, to: int) -> Column:
        return F.shiftleft(masked(c, shift, mask), to)

    exact = [lane(f"_e{k}0", 0, 0x7FFFFFFF, 0).bitwiseOR(lane(f"_e{k}1", 0, 0x7FFFFFFF, 32)) for k in range(EXACT)]
    slim = [lane(f"_s0{j}", 0, 0x7FFF, 0).bitwiseOR(lane(f"_s0{j}", 32, 0x7FFF, 16)).bitwiseOR(lane(f"_s1{j}", 0, 0x7FFF, 32)).bitwiseOR(lane(f"_s1{j}", 32, 0x7FFF, 48)) for j in range(_LONGS)]
    return summed.select(*keys, F.array(*exact, F.col("_one").bitwiseAND(_long(0x7FFFFFFF)), *slim).alias("fp"))


def hexed(fp: Column) -> Column:
    """A fingerprint as a string of 16 hex digits a long."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _let(value: Column, body) -> Column:
    """body(value) with the value evaluated once: what stands inside a lambda is evaluated anew each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _signed(fp: Column) -> Column:
    """COMPONENTS sums of signs, read as numbers from -2**14 to 2**14 - 1."""

    def spread(count: Column) -> Column:
        lane = lambda k: lambda x: (F.pmod(2 * F.shiftrightunsigned(x, 16 * k).bitwiseAND(_long(0x7FFF)) - count + (1 << 14), _long(1 << 15)) - (1 << 14)).cast("double")
        return F.flatten(F.array(*[F.transform(F.slice(fp, EXACT + 2, _LONGS), lane(k)) for k in range(4)]))

    return _let(F.element_at(fp, EXACT + 1), spread)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine between the clause counts of two texts as their fingerprints tell it, about 0.09 uncertain.

    Exactly 1 for equal fingerprints, and 0 where only one has clauses. Clauses counted over 16,383 times more than others wrap around.
    """

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    def cosine(v: Column) -> Column:
        norm = F.sqrt(dot(v["x"], v["x"])) * F.sqrt(dot(v["y"], v["y"]))
        return F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(v["x"], v["y"]) / norm))).otherwise(0.0)

    return F.when(a == b, 1.0).otherwise(_let(F.struct(_signed(a).alias("x"), _signed(b).alias("y")), cosine))


PLACE = ["_nul", "_id", "_key"]


def _placed(docs: DataFrame) -> DataFrame:
    """(_nul, _id, _key, _text): the place of each row, its id and the hash of its text; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").isNull().alias("_nul"), F.coalesce(F.col("doc_id").cast("long"), _long(0)).alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))


def _places(docs: DataFrame) -> DataFrame:
    """(_nul, _id, _key, _n, _text): one row for each place, with the number of its rows.

    Copies are counted inside the tasks that read them, so that a hot document reaches the shuffle once a task.
    """
    return _placed(docs).groupBy(*PLACE).agg(F.count("*").alias("_n"), F.any_value("_text").alias("_text"))


def _following(docs: DataFrame) -> DataFrame:
    """(_nul, _id, _key, _m, _nul2, _id2, _key2): each place and the next one by descending (id, key), the first after the last; _m: a third of its characters.

    Places are dealt out by ranges; what follows the last of a range is the first of the next range, one row a range.
    """
    places = _placed(docs).select(*PLACE, F.floor(F.length("_text") / 3).cast("int").alias("_m")).groupBy(*PLACE).agg(F.any_value("_m").alias("_m"))
    ranged = checkpoint(places.repartitionByRange(partitions(docs.sparkSession), "_nul", F.desc("_id"), F.desc("_key")).withColumn("_range", F.spark_partition_id()))
    edges = ranged.groupBy("_range").agg(F.min_by(F.struct(*PLACE), F.struct("_nul", F.bitwise_not("_id"), F.bitwise_not("_key"))).alias("_first"))
    around = F.expr("lead(_first) over (order by _range)"), F.expr("first(_first) over (order by _range)")
    edges = edges.select(F.col("_range").alias("_r"), F.coalesce(*around).alias("_first"))  # a row for each range
    within = ranged.withColumn("_follows", F.expr("lead(struct(_nul, _id, _key)) over (partition by _range order by _nul, _id desc, _key desc)"))
    after = F.coalesce("_follows", "_first")
    return within.join(F.broadcast(edges), F.col("_range") == F.col("_r")).select(*PLACE, "_m", *[after[c].alias(f"{c}2") for c in PLACE])


def edited(docs: DataFrame) -> DataFrame:
    """(_nul, _id, _key, _n, _m, _text, _edited, _nul2, _id2, _key2): one row for each place, with its edited text and the next place.

    The last third of the code points gives way to as many of the next document's first (or all of them).
    """
    texts, follows = _places(docs), _following(docs)
    # The filter says nothing: it keeps the column, so that both joins read one exchange of the texts.
    ahead = texts.where("_n > 0").toDF(*[f"{c}2" for c in PLACE], "_n2", "_text2")
    heads = follows.join(ahead, [f"{c}2" for c in PLACE]).select(*PLACE, "_m", *[f"{c}2" for c in PLACE], F.substring("_text2", F.lit(1), F.col("_m")).alias("_head"))
    kept = F.substring("_text", F.lit(1), F.length("_text") - F.col("_m"))
    return texts.join(heads, PLACE).select(*PLACE, "_n", "_m", "_text", F.concat(kept, "_head").alias("_edited"), *[f"{c}2" for c in PLACE])


def compare_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next double) for each row of docs.

    Next is by descending doc_id, documents of one id by descending hash of the text, null ids last; after the last
    comes the first. Rows that share id and text are one document and come as often as before. A null text is empty. Columns other than
    doc_id and text are not read. An empty table gives an empty one.
    """
    own = checkpoint(fingerprints(_placed(docs), PLACE, "_text", copies=True))
    carried = [*PLACE, "_copies", *[f"{c}2" for c in PLACE], "n_chars", "edited_sha256"]
    changed = edited(docs).withColumnRenamed("_n", "_copies").select("*", F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"))
    changed = fingerprints(changed, carried, "_edited").withColumnRenamed("fp", "edited_fp")
    rows = changed.join(own, PLACE).join(own.toDF(*[f"{c}2" for c in PLACE], "next_fp"), [f"{c}2" for c in PLACE])
    shown = rows.select(F.when(~F.col("_nul"), F.col("_id")).alias("doc_id"), "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "_copies")
    return shown.select("*", F.explode(F.sequence(_long(1), F.col("_copies"))).alias("_k")).drop("_copies", "_k")

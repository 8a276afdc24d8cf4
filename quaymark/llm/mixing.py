"""Mixing sources to target weights.

The words of each source form one stream, cut into blocks of `block` words.  Water-filling gives each
source a target: shares by weight, stopped at `cap` times the source's size, the excess reshared.  A source
gets as many slots as its target needs.  Each output shard draws how many it takes of each source from a multinomial;
what the draws miss of the targets is put right by a few exchanges between sources.  Slot numbers go
through a pseudorandom permutation of the source's block numbers, once for each turn through the source,
and a join by block number brings the document spans.  The last slot of a source is cut so that its words
meet the rounded target; the short block at the end of a stream comes last in each turn.

Nothing depends on the run: seeds are hashes of source names, the order of a stream is a hash of the ids.
Streams are numbered by a two-level running sum, so that a source with a third of all rows is spread over
many tasks.  One row for each source is gathered in one place to rank the names, and one number for each source is
broadcast for the draws; more than `MOST_SOURCES` sources are an error.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source, ranked last; equal
rows are separate documents; an empty table gives an empty mix; other columns are ignored (`mixed_texts`
keeps the columns of documents).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.llm.common import WORD, free_name, keep, running_sum, utf8

MOST_SOURCES = 1 << 20


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Append target to (source, source_size): water-filling of `share` times the total under the caps."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))).withColumn("top", cap * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("top") / F.col("w")).withColumn("goal", share * F.sum("source_size").over(everything))
    full_first = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    stopped = F.coalesce(F.sum("top").over(full_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(full_first.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("goal") - stopped) / left)
    # the first source whose level stays under its ratio sets the level of all that are not stopped
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return rows.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("top")), F.col("top")).alias("target"))


def permuted(k: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size-1, by a Feistel network that walks on until it is inside."""
    half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(zlib.crc32(f"{key}/{r}".encode()) | 1) for r in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        with np.errstate(over="ignore"):
            for r in keys:
                f = (right + r) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(k.astype(np.uint64))
    while (far := out >= size).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _seed(source: str | None, seed: int) -> int:
    return zlib.crc32(f"{seed}/{'N' if source is None else 'S' + source}".encode())


def draw(goals: DataFrame, shards: int, block: int, seed: int) -> DataFrame:
    """(source, size, want, shard, n_slots, first_slot): how many slots of each source each output shard gets.

    Shards have equal sizes.  Each draws its source counts from a multinomial whose shares are those of the sources'
    slots.  The draws miss the sources' totals by a little: sources drawn too often give slots back, here and there in a
    fixed pseudorandom order, and sources drawn too rarely take these places, so that shards keep their sizes.
    """
    spark, size = goals.sparkSession, F.col("source_size")
    want = F.least(F.floor(F.col("target") + 0.5), 2 * size)
    per_turn = F.floor(size / block) + (size % block > 0).cast("long")
    n = F.floor(want / size) * per_turn + F.ceil(want % size / block)
    plan = goals.where("source_size > 0 and target >= 0.5").select(F.col("source").cast("string").alias("source"), size.alias("size"), want.cast("long").alias("want"), n.cast("long").alias("slots"))
    plan = keep(plan.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1), "mix-plan")
    if plan.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    slots_of = plan.select("number", "slots").toArrow().sort_by("number")["slots"].to_numpy()  # one number for each source
    total, shares = int(slots_of.sum()), spark.sparkContext.broadcast(slots_of / max(1, slots_of.sum()))

    def deal(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = np.random.Generator(np.random.PCG64([seed, shard])).multinomial(total // shards + (shard < total % shards), shares.value)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"number": some, "shard": np.full(len(some), shard), "n": counts[some]})

    drawn = keep(spark.range(0, shards if total else 0, 1, max(1, min(shards, 256))).mapInArrow(deal, "number long, shard long, n long"), "mix-drawn")
    off = keep(plan.join(drawn.groupBy("number").agg(F.sum("n").alias("got")), "number", "left").select("number", (F.coalesce("got", F.lit(0)) - F.col("slots")).alias("off")), "mix-off")
    over = running_sum(drawn.join(off.where("off > 0"), "number"), ["number"], ["shard"], F.col("n"), "before")
    back = over.select("number", "shard", F.greatest(F.lit(0), F.least("n", F.col("off") - F.col("before"))).alias("n")).where("n > 0")
    back = keep(running_sum(back, [], ["number", "shard"], F.col("n"), "place"), "mix-back")
    lacking = off.where("off < 0").select("number", (-F.col("off")).alias("n")).toArrow().sort_by("number")  # at most one number for each source
    takers = spark.sparkContext.broadcast((lacking["number"].to_numpy(), np.cumsum(lacking["n"].to_numpy())))

    def take(batches):
        number, ends = takers.value
        for batch in batches:
            rows = []
            for shard, n, place in zip(*[batch.column(c).to_pylist() for c in ("shard", "n", "place")], strict=True):
                k = int(np.searchsorted(ends, place, "right"))
                while n:
                    m = min(n, int(ends[k]) - place)
                    rows.append((int(number[k]), shard, m))
                    n, place, k = n - m, place + m, k + 1
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("number", "shard", "n"), cols, strict=True)})

    given = back.select("shard", "n", "place").mapInArrow(take, "number long, shard long, n long")
    every = drawn.unionByName(back.select("number", "shard", (-F.col("n")).alias("n"))).unionByName(given)
    every = every.groupBy("number", "shard").agg(F.sum("n").alias("n_slots")).where("n_slots > 0")
    out = keep(running_sum(every, ["number"], ["shard"], F.col("n_slots"), "first_slot"), "mix-draws")
    return out.join(plan, "number").select("source", "size", "want", "shard", "first_slot", "n_slots")


def slots(draws: DataFrame, block: int, seed: int, tasks: int) -> DataFrame:
    """(source, shard, slot, turn, block, words): where each slot points and how many words it takes of its block."""

    def point(batches):
        for batch in batches:
            for source, size, want, shard, first, n in zip(*batch.to_pydict().values(), strict=True):
                full, tail = divmod(size, block)
                per_turn = full + (tail > 0)
                for at in range(first, first + n, 100_000):
                    slot = np.arange(at, min(at + 100_000, first + n))
                    turn, k = np.divmod(slot, per_turn)
                    to = k.copy()
                    inner = k < full
                    to[inner] = permuted(k[inner], full, _seed(source, seed)) if full else k[inner]
                    words = np.where(inner, block, tail)
                    before = turn * size + k * block  # the short block is last in each turn
                    words = np.minimum(words, want - before)
                    m = len(slot)
                    yield pa.RecordBatch.from_pydict({"source": pa.array([source] * m, pa.string()), "shard": np.full(m, shard), "slot": slot, "turn": turn, "block": to, "words": words})

    # a draw is a short row that stands for many slots: deal the rows out before they grow
    return draws.repartition(tasks, F.xxhash64("source", "shard")).mapInArrow(point, "source string, shard long, slot long, turn long, block long, words long")


def place(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(doc_id, source, size, start, *extra) of each document: its place in the stream of its source."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *(extra or []))
    rows = keep(rows, "mix-sizes")
    return keep(running_sum(rows, ["source"], ["doc_id", "size", *[c for c in rows.columns if c not in ("doc_id", "source", "size")]], F.col("size"), "start"), "mix-places")


def mix(places: DataFrame, block: int = 128, shard_words: int = 1 << 20, seed: int = 7, **aim) -> tuple[DataFrame, DataFrame]:
    """(goals, spans).  goals: (source, source_size, target).  spans: one row for each slot and document in it.

    A span says which words of the document (from_word to to_word, the first is 0) the slot takes.
    """
    goals = keep(targets(places.groupBy("source").agg(F.sum("size").alias("source_size")), **aim), "mix-goals")
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, int(total // shard_words) + 1)
    drawn = slots(draw(goals, shards, block, seed), block, seed, max(32, int(total // block // 100_000)))
    last = F.col("start") + F.col("size") - 1
    pieces = places.where("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))).alias("block"))
    pieces = pieces.withColumn("from_word", F.greatest(F.lit(0), F.col("block") * block - F.col("start"))).withColumn("begin", F.col("start") + F.col("from_word") - F.col("block") * block)
    d = drawn.select(F.col("source").alias("s"), "shard", "slot", "turn", F.col("block").alias("b"), "words")
    # a few draws stand for many slots, which Spark cannot know: left alone it would broadcast them all
    spans = pieces.join(d.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    spans = spans.withColumn("to_word", F.least(F.col("size"), F.col("from_word") + F.least(F.lit(block), F.col("words")) - F.col("begin"))).where("to_word > from_word")
    return goals, spans.drop("begin", "words")


def taken(docs: DataFrame, **params) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken."""
    places = place(docs)
    goals, spans = mix(places, **params)
    used = spans.groupBy("source", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken")).select(F.col("source").alias("s"), F.col("start").alias("at"), "taken")
    out = places.join(used, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left").drop("s", "at")
    g = goals.select(F.col("source").alias("s"), "source_size", "target")
    return out.join(g, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


_WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The words of each text inside the spans, as they stand there; spans that do not touch are put on lines of their own."""
    out = []
    for text, own in zip(utf8(texts), spans.to_pylist(), strict=True):
        at = [m.span() for m in _WORD_BYTES.finditer(text)]
        joined: list[list[int]] = []
        for s in sorted(own, key=lambda s: s["a"]):
            if joined and joined[-1][1] == s["a"]:
                joined[-1][1] = s["b"]
            else:
                joined.append([s["a"], s["b"]])
        whole = len(joined) == 1 and joined[0] == [0, len(at)]
        out.append(text.decode() if whole else "\n".join(text[at[a][0] : at[b - 1][1]].decode() for a, b in joined))
    return pa.array(out, pa.string())


def mixed_texts(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents: one row for each document and turn, with the words taken in that turn.

    A text that is taken whole stays as it is; `n_chars`, where there is one, is counted anew.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    places = place(docs, [key.alias("text_key")])
    _, spans = mix(places, **params)
    rows = spans.groupBy("source", "start", "turn", "doc_id", "text_key").agg(F.collect_list(F.struct(F.col("from_word").alias("a"), F.col("to_word").alias("b"))).alias("spans"))
    own = [free_name(docs, n) for n in ("mix_doc", "mix_source", "mix_text", "mix_key", "mix_spans")]
    d, src, k, text_key, taken_spans = own
    rows = rows.select(F.col("doc_id").alias(d), F.col("source").alias(src), F.col("text_key").alias(k), F.col("spans").alias(taken_spans))
    texts = docs.withColumn(text_key, key)
    if not places.groupBy("doc_id", "source", "text_key").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id", "source", text_key])  # equal rows have a decision each, and share their text
    same = F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(src)) & (F.col(text_key) == F.col(k))
    out = texts.join(rows, same).withColumn("text", F.arrow_udf(_cut, "string")("text", taken_spans))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

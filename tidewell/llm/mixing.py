"""Mixing sources to target weights, with DataFrame functions only.

Each source's words are packed, in a fixed order of its documents, into blocks of
equal length. For each output shard multinomial counts of the sources are drawn; the
draws of a source, numbered from shard to shard, run through pseudorandom permutations
of its block numbers, one for each pass, and blocks are joined to slots by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, repeated, table, words_of

#: Hash buckets of each source in which running sums of sizes are taken, at least; rows for each of more.
BUCKETS, BUCKET_ROWS = 1024, 65_536
#: Slots of an output shard, and tasks that draw or spread shards at most.
SHARD_SLOTS, MOST_TASKS = 16_384, 20_000
#: Rounds of a permutation.
ROUNDS = 24
#: Up to so many sources their table is broadcast (under 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def rounds_of(n: Column, *keys: Column) -> Column:
    """Array of (r, k): each round of a permutation with its key."""
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.struct(r.alias("r"), F.pmod(F.xxhash64(r, n, *keys), n).alias("k")))


def permuted(x: Column, n: Column, *keys: Column, rounds: Column | None = None) -> Column:
    """A keyed pseudorandom permutation of 0 .. n - 1: a swap-or-not shuffle, exact for every n.

    Each round pairs x with (k - x) mod n, and a hash of round and pair's larger
    member decides whether they change places. rounds: rounds_of the same n and keys,
    where many numbers share them.
    """

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(r["k"] - at, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(at, other), r["r"], n, *keys), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(rounds_of(n, *keys) if rounds is None else rounds, x.cast("long"), step)


def with_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """sources (source, source_size) with rank, weight and target.

    Sources by code point, null last, take the weights in turn. Targets share the sum
    of all sizes by weight; one that would exceed cap times its source's size stops
    there, and the rest is shared again. In order of cap by weight, a source is capped
    exactly if it would be with all before it capped, so running sums find the level.
    The table has a row for each source and meets in one task.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_code) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, all_weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    gone, weight_gone = F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumns({"total": total.cast("double"), "capped": F.col("most") * (all_weights - weight_gone) <= F.col("weight") * (total - gone), "all_weights": all_weights})
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0.0))
    left = F.col("all_weights") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0.0))
    share = F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * F.try_divide(F.col("total") - spent, left))
    return ranked.select("source", "source_size", F.col("rank").cast("long").alias("source_id"), "weight", share.alias("target"))


class Mix:
    """A mix of documents; the parts are DataFrames.

    sources: source, source_size, source_id, weight, target, blocks, slots, first_slot, all_slots.
    pieces: doc_id, source_id, size, start, block, words: the words of each document's row in each block.
    drawn: shard, source_id and n, the multinomial counts of each output shard.
    slots: source_id, block, epoch, and shard and slot, the place in the output.
    blocks: the output, a row for each slot with its pieces of text.
    taken and counted: how many words of each row the output holds, counted in its texts or from slots and pieces alone.

    docs needs doc_id, source and text; other columns are ignored. A size is the number
    of white-space separated words, 0 for null or empty text; such documents are in no
    block. A null source is a source of its own. Rows count as often as they come; the
    same rows give the same mix in any order or partitioning. An empty table gives
    empty parts.

    Free draws stray from the targets by the root of their number. So a source's draws
    beyond its target, which lie in the last shards, go to the sources that fell short,
    and every total meets its target to a block.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = 64, shard_slots: int = SHARD_SLOTS, seed: int = 11):
        self.docs, self.spark = docs, docs.sparkSession
        self.block, self.shard_slots, self.seed, self.cap = block, shard_slots, seed, cap
        rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size"))
        self.rows = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
        sources = self.rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
        blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
        epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
        rest = F.coalesce(F.round((F.col("target") - epochs * F.col("source_size")) * F.try_divide(blocks, "source_size")), F.lit(0)).cast("long")
        dealt = with_targets(sources, weights, cap).withColumns({"blocks": blocks, "slots": epochs * blocks + rest})
        running = Window.orderBy("source_id")
        dealt = dealt.withColumns({"first_slot": F.coalesce(F.sum("slots").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all_slots": F.sum("slots").over(running.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        self.sources = cut(dealt)
        self.small = self.sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
        self.buckets = max(BUCKETS, self.rows.count() // BUCKET_ROWS)
        some = self.sources.agg(F.coalesce(F.max("all_slots"), F.lit(0)), F.coalesce(F.count_if(F.col("slots") > 0), F.lit(0))).first()
        self.all_slots, self.held = int(some[0]), int(some[1])
        self.shards = -(-self.all_slots // shard_slots)
        self.drawn = cut(self._drawn())

    def _drawn(self) -> DataFrame:
        """Each slot draws a number below all slots, and with it the source whose range of numbers holds it.

        Cells of equal width list the sources whose ranges they meet, two on average, so a draw looks at few
        however many sources there are.
        """
        width = max(1, -(-self.all_slots // max(1, self.held)))
        end = F.col("first_slot") + F.col("slots")
        cells = self.sources.where("slots > 0").select("source_id", end.alias("end"), F.explode(F.sequence(F.expr(f"first_slot div {width}"), F.expr(f"(first_slot + slots - 1) div {width}"))).alias("cell"))
        cells = cells.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("end", "source_id"))).alias("ranges"))
        draw = F.pmod(F.xxhash64("shard", "slot", F.lit(self.seed).cast("long")), F.lit(max(1, self.all_slots)).cast("long"))
        places = self.spark.range(self.shards).withColumnRenamed("id", "shard").repartition(max(1, min(self.shards, MOST_TASKS)), "shard")
        places = places.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), self._shard_size() - 1)).alias("slot"))
        draws = places.withColumn("draw", draw).withColumn("cell", F.expr(f"draw div {width}"))
        draws = draws.join(F.broadcast(cells) if self.small else cells, "cell")
        source = F.filter("ranges", lambda r: F.col("draw") < r["end"])[0]["source_id"]
        return draws.groupBy("shard", source.alias("source_id")).agg(F.count("*").alias("n"))

    def _shard_size(self) -> Column:
        return F.least(F.lit(self.shard_slots).cast("long"), F.lit(self.all_slots) - F.col("shard") * self.shard_slots)

    def by_source(self, columns: list[str]) -> DataFrame:
        part = self.sources.select(*columns)
        return F.broadcast(part) if self.small else part

    @property
    def placed(self) -> DataFrame:
        """self.rows that have words, with at, the place of the first of their copies in the source."""
        ids = self.by_source(["source", "source_id"]).withColumnRenamed("source", "_source")
        rows = self.rows.join(ids, F.col("source").eqNullSafe(F.col("_source"))).where("size > 0").drop("source", "_source")
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(self.buckets)))
        sums = rows.groupBy("source_id", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
        upto = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("source_id", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("source_id", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        return rows.join(offsets, ["source_id", "bucket"]).withColumn("at", F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))

    @property
    def each(self) -> DataFrame:
        """doc_id, source_id, size and start of each document's row that has words."""
        each = repeated(self.placed, F.col("copies"), "nth").select("doc_id", "source_id", "size", "at", "nth")
        return each.select("doc_id", "source_id", "size", (F.col("at") + F.col("nth") * F.col("size")).alias("start"))

    @property
    def pieces(self) -> DataFrame:
        first, last = F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}")
        spread = self.each.withColumn("block", F.explode(F.sequence(first, last)))
        words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block) - F.greatest("start", F.col("block") * self.block)
        return spread.withColumn("words", words)

    @property
    def texts(self) -> DataFrame:
        """The pieces with their text, the piece's words joined by single spaces."""
        ids = self.by_source(["source", "source_id"]).withColumnRenamed("source", "_source")
        docs = self.docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", F.size(words_of(F.col("text"))).cast("long").alias("size"))
        docs = docs.join(ids, F.col("source").eqNullSafe(F.col("_source")))
        # In a struct nulls are equal; of one type on both sides, so that window and join share one exchange of the texts.
        key = F.struct("doc_id", F.coalesce("size", F.lit(0).cast("long")).alias("size")).alias("_k")
        docs = docs.select("source_id", key, "text")
        docs = docs.withColumn("nth", F.row_number().over(Window.partitionBy("source_id", "_k").orderBy("text")) - 1)
        places = self.placed.select("source_id", key, "at")
        rows = docs.join(places.hint("merge"), ["source_id", "_k"])
        rows = rows.select("source_id", F.col("_k.doc_id").alias("doc_id"), F.col("_k.size").alias("size"), (F.col("at") + F.col("nth") * F.col("_k.size")).alias("start"), "text")

        def piece(words: Column, b: Column) -> Column:
            low, high = F.greatest(F.col("start"), b * self.block), F.least(F.col("start") + F.col("size"), (b + 1) * self.block)
            text = F.array_join(F.slice(words, (low - F.col("start") + 1).cast("int"), (high - low).cast("int")), " ")
            return F.struct(b.alias("block"), (high - low).alias("words"), text.alias("text"))

        numbers = F.sequence(F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}"))
        # The words are a variable of the outer function, so that a text is split once and not for each piece.
        parts = F.transform(F.array(words_of(F.col("text"))), lambda words: F.transform(numbers, lambda b: piece(words, b)))[0]
        return rows.select("doc_id", "source_id", "size", "start", F.inline(parts))

    @property
    def slots(self) -> DataFrame:
        before = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        inside = Window.partitionBy("shard").orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
        counts = self.drawn.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "place": F.coalesce(F.sum("n").over(inside), F.lit(0))})
        counts = counts.join(self.by_source(["source_id", "slots", "blocks"]), "source_id")
        kept = F.least(F.col("n"), F.greatest(F.col("slots") - F.col("first"), F.lit(0)))
        # A fixed number of tasks: few bytes stand for many slots, so sizes must not merge them.
        counts = counts.withColumn("kept", kept).repartition(max(1, min(4 * self.shards, MOST_TASKS)), "shard", "source_id")
        span = lambda a, b: F.explode(F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))).alias("i")
        # Slots of one source and epoch share a permutation; its rounds' keys are taken once for a run of them.
        seed = F.lit(self.seed).cast("long")
        key = (F.col("blocks"), seed, F.col("source_id"), F.col("epoch"))
        runs = counts.where("kept > 0").withColumn("epoch", F.explode(F.sequence(F.expr("first div blocks"), F.expr("(first + kept - 1) div blocks"))))
        low, high = F.greatest(F.col("first"), F.col("epoch") * F.col("blocks")), F.least(F.col("first") + F.col("kept"), (F.col("epoch") + 1) * F.col("blocks"))
        runs = runs.select("shard", "source_id", "blocks", "epoch", (F.col("place") - F.col("first")).alias("ahead"), low.alias("low"), high.alias("high"), rounds_of(*key).alias("rounds"))
        own = runs.select("shard", "source_id", "blocks", "epoch", "ahead", "rounds", span(F.col("low"), F.col("high")))
        block = permuted(F.col("i") - F.col("epoch") * F.col("blocks"), *key, rounds=F.col("rounds"))
        own = own.select("shard", "source_id", block.alias("block"), "epoch", (F.col("ahead") + F.col("i")).alias("place"))

        # Draws beyond a source's slots, and the slots that draws left open, both numbered in the order of sources.
        totals = self.sources.where("slots > 0").join(self.drawn.groupBy("source_id").agg(F.sum("n").alias("drawn")), "source_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        running = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
        over, short = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
        totals = totals.select("source_id", "blocks", "drawn", short.alias("short"), *(F.coalesce(F.sum(x).over(running), F.lit(0)).alias(c) for x, c in ((over, "over_before"), (short, "short_before"))))
        first_over = totals.select("source_id", "over_before")
        beyond = counts.where("kept < n").join(F.broadcast(first_over) if self.small else first_over, "source_id")
        beyond = beyond.select("shard", "place", "first", "slots", "over_before", span(F.col("kept"), F.col("n")))
        beyond = beyond.select("shard", (F.col("place") + F.col("i")).alias("place"), (F.col("over_before") + F.col("first") + F.col("i") - F.col("slots")).alias("j"))
        open_ = repeated(totals.where("short > 0"), F.col("short"), "i").select("source_id", "blocks", (F.col("short_before") + F.col("i")).alias("j"), (F.col("drawn") + F.col("i")).alias("q"))
        moved = beyond.join(open_.hint("merge"), "j").select("shard", "source_id", "blocks", "place", "q")

        moved = moved.withColumns({"epoch": F.expr("q div blocks"), "_i": F.expr("q % blocks")})
        moved = moved.select("shard", "source_id", permuted(F.col("_i"), *key).alias("block"), "epoch", "place")
        each = own.unionByName(moved).withColumn("slot", permuted(F.col("place"), self._shard_size(), seed, F.col("shard")))
        return each.select("source_id", "block", "epoch", "shard", "slot")

    @property
    def shard_counts(self) -> DataFrame:
        """Slots of each source in each output shard, after the totals were met."""
        return self.slots.groupBy("shard", "source_id").agg(F.count("*").alias("slots"))

    @property
    def blocks(self) -> DataFrame:
        """The output: shard, slot, source_id, block and the pieces of documents in it with their text, in order."""
        content = self.texts.groupBy("source_id", "block").agg(F.sort_array(F.collect_list(F.struct("start", "doc_id", "size", "words", "text"))).alias("pieces"))
        return self.slots.join(content.hint("merge"), ["source_id", "block"])

    @property
    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target and taken of every row of the documents, counted in the texts of the output."""
        text = F.col("p.text")
        words = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
        held = self.blocks.select("source_id", F.explode("pieces").alias("p")).groupBy("source_id", F.col("p.start").alias("start")).agg(F.sum(words).alias("words"))
        took = self.each.join(held.hint("merge"), ["source_id", "start"], "left")
        return self._described(took.select("doc_id", "source_id", "size", F.coalesce("words", F.lit(0)).cast("long").alias("taken")))

    @property
    def counted(self) -> DataFrame:
        """taken without the output: slots counted by block, and the pieces' words."""
        times = self.slots.groupBy("source_id", "block").agg(F.count("*").alias("times"))
        # The planner takes the slots for as few as the sources they come from, so the hint keeps them from being broadcast.
        took = self.pieces.join(times.hint("merge"), ["source_id", "block"], "left").groupBy("doc_id", "source_id", "size", "start")
        took = took.agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")).drop("start")
        return self._described(took)

    def _described(self, took: DataFrame) -> DataFrame:
        empty = self.rows.where("size = 0").join(self.by_source(["source", "source_id"]).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        empty = repeated(empty, F.col("copies"), "nth").select("doc_id", "source_id", "size", F.lit(0).cast("long").alias("taken"))
        return took.unionByName(empty).join(self.by_source(["source_id", "source", "source_size", "target"]), "source_id").drop("source_id")


def mix_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """Whole documents, not packed, repeated as the mix takes their words: taken / size times on average, 0 to cap.

    The part of a pass that remains is rounded by a hash of the doc_id. Documents
    without words come once. Equal doc_ids with one size share what they take evenly.
    """
    mix = Mix(docs, seed=seed)
    rate = mix.counted.where("size > 0").groupBy("doc_id", "source", "size").agg(F.avg(F.col("taken") / F.col("size")).alias("_rate"))
    rate = rate.select(F.col("doc_id").alias("_doc"), F.col("source").alias("_from"), F.col("size").alias("_size"), "_rate")
    size = F.size(words_of(F.col("text"))).cast("long")
    on = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_from")) & (F.col("_words") == F.col("_size"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    times = F.when(F.col("_words") == 0, F.lit(1)).otherwise(F.floor(F.coalesce("_rate", F.lit(0.0)) + chance).cast("int"))
    joined = docs.withColumn("_words", size).join(rate, on, "left").withColumn("_times", times).where("_times > 0")
    return joined.withColumn("_nth", F.explode(F.sequence(F.lit(1), "_times"))).select(*[docs[c] for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken.select("doc_id", "size", "source_size", "target", "taken")

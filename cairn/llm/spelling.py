"""Spelling variants: words at one edit from each other, and the form that a rare spelling most likely stands for.

Method. The vocabulary is cut into ranges of its order, and every range becomes a compact trie shard: node by node, the labels of its
edges, where they begin, and how often the word that ends there occurs. Shards are broadcast, a bounded group of them at a time, and every
word's distance-one Levenshtein automaton is intersected with every shard depth-first: the walk keeps to the word while no edit is spent
and, at each node it reaches, spends the edit on a deletion, a replacement or an insertion, after which the rest of the word must be there.
A neighbour that a shard accepts is emitted once. A task adds up what its shards accept; a shuffle of one small row for each word and group
of shards sums the counts and keeps the best form.

Scale. Occurrences are counted by partial aggregates, so a frequent word reaches a reducer once a task. A shard has at most SHARD_LETTERS
letters (or one longer word), a group at most GROUP_BYTES, so neither the driver nor a worker holds more of the vocabulary, whatever its
size; more words make more rounds over the vocabulary, each written to the shared folder. Nothing is paired within a group: a word meets
only what its automaton accepts. Chains of forms grow at least FACTOR-fold with each step, so that pointer jumping ends after a few joins.

Odd rows. A null text has no words; a null document id draws no deletion. Words of any length are taken whole. Equal rows count each on
their own. Ties between forms go to the smallest in code-point order. An empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Letters of a word; all of them are one byte in Latin-1, in the order of their code points.
LETTERS = "a-zÀ-ÿ"
LEAST_CHARS = 6
LEAST_COUNT = 5

#: A form occurs at least so many times as often as the word that it stands for.
FACTOR = 5

#: Of every so many occurrences, by their checksum, one loses a letter.
DROP = 199

#: Letters of the words of a shard at most, but for a single longer word.
SHARD_LETTERS = 400_000

#: Bytes of the shards that are broadcast together; a node takes NODE_BYTES.
GROUP_BYTES = 64 << 20
NODE_BYTES = 13

#: Words that a task looks up.
TASK_WORDS = 20_000

Trie = tuple[bytes, array, array]


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word): every occurrence of a word of at least least_chars letters; one in DROP loses the letter that its checksum picks."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    left = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(F.col("h") % DROP == 0, left).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_chars)


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words with their number of occurrences."""
    return occurrences(docs, least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def trie_of(words: list[bytes], counts: list[int]) -> Trie:
    """Different words in ascending order as labels, first edges and counts; edge k leads to node k + 1, and a count of 0 ends no word."""
    labels, starts, ends, todo = bytearray(), array("I"), array("q"), deque([(0, len(words), 0)])
    while todo:
        at, stop, depth = todo.popleft()
        starts.append(len(labels))
        if at < stop and len(words[at]) == depth:
            ends.append(counts[at])
            at += 1
        else:
            ends.append(0)
        while at < stop:
            letter, first = words[at][depth], at
            while at < stop and words[at][depth] == letter:
                at += 1
            labels.append(letter)
            todo.append((first, at, depth + 1))
    starts.append(len(labels))
    return bytes(labels), starts, ends


def accepted(word: bytes, trie: Trie) -> Iterator[tuple[bytes, int]]:
    """The trie's words at exactly one edit from word, with their counts, each once.

    Of edits that give the same word only one is walked: a letter is deleted at the end of its run, and inserted behind the run of its like.
    """
    labels, starts, ends = trie
    find, size, node = labels.find, len(word), 0
    for i in range(size + 1):
        first, last = starts[node], starts[node + 1]
        here = word[i] if i < size else -1
        tries = [(k + 1, j, word[:i] + labels[k : k + 1]) for k in range(first, last) if labels[k] != here for j in ((i, i + 1) if i < size else (i,))]
        if i < size and (i + 1 == size or word[i + 1] != here):
            tries.append((node, i + 1, word[:i]))
        for at, j, begun in tries:
            for c in word[j:]:
                k = find(c, starts[at], starts[at + 1])
                if k < 0:
                    break
                at = k + 1
            else:
                if ends[at]:
                    yield begun + word[j:], ends[at]
        k = find(here, first, last) if i < size else -1
        if k < 0:
            return
        node = k + 1


def shards(words: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(shard, bytes, labels, starts, ends): n words with their counts as trie shards, a written table."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, counts, letters = TaskContext.get().partitionId() << 32, [], [], 0

        def full() -> pa.RecordBatch:
            labels, starts, ends = trie_of(held, counts)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "bytes": pa.array([len(ends) * NODE_BYTES], pa.int64()), "labels": [labels], "starts": [starts.tobytes()], "ends": [ends.tobytes()]})

        for b in batches:
            for word, count in zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True):
                if held and letters + len(word) > SHARD_LETTERS:
                    yield full()
                    shard, held, counts, letters = shard + 1, [], [], 0
                held.append(word.encode("latin-1"))
                counts.append(count)
                letters += len(word)
        if held:
            yield full()

    ranges = words.repartitionByRange(max(1, -(-n * 10 // SHARD_LETTERS)), "word").sortWithinPartitions("word")
    return scratch.cut(ranges.mapInArrow(build, "shard long, bytes long, labels binary, starts binary, ends binary"), "shards")


def _groups(sizes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last shard of every group, of shards in order with their bytes."""
    out, room = [], 0
    for shard, size in sizes:
        if out and size <= room:
            out[-1] = (out[-1][0], shard)
        else:
            out.append((shard, shard))
            room = GROUP_BYTES
        room -= size
    return out


def neighbours(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have neighbours: how many, and the most frequent of them. words is a written table (word, n)."""
    spark, n = words.sparkSession, words.count()
    table = shards(words, n, scratch)
    sizes = sorted(map(tuple, table.select("shard", "bytes").collect()))  # two numbers a shard
    dealt = words.select("word").repartition(max(1, -(-n // TASK_WORDS)))
    for k, (first, last) in enumerate(_groups(sizes)):
        group = table.filter(F.col("shard").between(first, last)).select("labels", "starts", "ends").collect()  # at most GROUP_BYTES
        sent = spark.sparkContext.broadcast([(bytes(a), bytes(b), bytes(c)) for a, b, c in group])
        del group

        def look_up(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tries = [(a, array("I", b), array("q", c)) for a, b, c in sent.value]
            for b in batches:
                rows: list[tuple[str, int, str, int]] = []
                for text in b["word"].to_pylist():
                    word, count, best = text.encode("latin-1"), 0, (0, b"")
                    for t in tries:
                        for near, n in accepted(word, t):
                            count += 1
                            best = min(best, (-n, near))
                    if count:
                        rows.append((text, count, best[1].decode("latin-1"), -best[0]))
                names = {"word": pa.string(), "n_near": pa.int64(), "form": pa.string(), "form_n": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 4, names.values(), strict=True)], names=list(names))

        dealt.mapInArrow(look_up, "word string, n_near long, form string, form_n long").write.mode("append").parquet(scratch.path("near"))
        sent.unpersist()
    if not sizes:
        return spark.createDataFrame([], "word string, n_near long, form string, form_n long")
    found = spark.read.schema("word string, n_near long, form string, form_n long").parquet(scratch.path("near"))
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("f")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.f").alias("form"), (-F.col("b.m")).alias("form_n"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of links (word, root), each followed to its end by pointer jumping; links must not go round in circles."""
    at, k, moved = scratch.cut(links, "roots-0"), 0, True
    while moved:
        k += 1
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.cut(at.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{k}")
        moved = not step.filter("moved").isEmpty()
        scratch.drop(f"roots-{k - 1}")
        at = step.drop("moved")
    return at


def variants(docs: DataFrame, scratch: Scratch, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents.

    form is the most frequent word at one edit if it occurs at least factor times as often, else null; root is where forms lead to in the
    end, the word itself if it has no form. factor must be over 1, so that forms never lead back.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1")
    words = scratch.cut(vocabulary(docs, least_chars, least_count), "words")
    clear = F.col("form_n") >= factor * F.col("n")
    scored = words.join(neighbours(words, scratch), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(clear, F.col("form")).alias("form"), F.when(clear, F.col("form_n")).alias("form_n"))
    scored = scratch.cut(scored, "scored")
    ends = roots(scored.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), scratch)
    return scored.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(found: DataFrame, most: int = 10) -> DataFrame:
    """(root, n, n_forms, variants) of variants(): every root with all its spellings' occurrences and its `most` most frequent other spellings."""
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n"), "word"))
    other = found.filter("word <> root").withColumn("r", rank).filter(F.col("r") <= most).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("v"))
    total = found.groupBy("root").agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))
    return total.join(other, "root", "left").select("root", "n", "n_forms", F.coalesce(F.col("v.word"), F.array().cast("array<string>")).alias("variants"))

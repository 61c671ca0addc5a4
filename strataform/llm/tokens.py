"""Problem 6, encoding of the whole corpus with a public tokenizer, through the distinct words of the corpus.

Texts are cut into pre-tokens in the JVM, the distinct pre-tokens of the corpus are encoded once each, the ids are joined back to the
occurrences and put together by position. The words that fit a bound meet their occurrences where these are, by hash in Arrow memory;
the others are exploded with the places they leave and meet their words in a shuffle. Decoding joins the table of the tokens' bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.operators.skew import BROADCAST_BYTES, is_within, join_hot, spread
from strataform.sources.shared import written

#: Fixed value: white space of the tokenizer's pattern; in Java \s alone is ASCII.
_S = r"\s\p{Z}\x85"
#: Fixed value: the pre-token pattern of byte-level BPE, in Java's dialect.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Code points the JVM's Unicode tables don't know yet; texts with them are cut by the tokenizer itself.
UNKNOWN = r"\p{Cn}"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def pre_tokens(text: Column, path: str) -> Column:
    """The pre-tokens of a text in order; null for null."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def by_tokenizer(texts):
        import pyarrow as pa

        cut = lambda t: [t[a:b] for _, (a, b) in load(path).pre_tokenizer.pre_tokenize_str(t)]
        return pa.array([cut(t) if t is not None else None for t in texts.to_pylist()], pa.list_(pa.string()))

    rare = F.when(text.rlike(UNKNOWN), text)
    return F.coalesce(by_tokenizer(rare), F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0)))


def id_width(path: str) -> int:
    """Bytes of an id in a packed list."""
    return 2 if load(path).get_vocab_size() <= 1 << 16 else 4


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """word, packed (the ids, each of id_width bytes) of a table of distinct words."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tokenizer = load(path)
        kind = f"<u{id_width(path)}"
        for batch in batches:
            encoded = tokenizer.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            packed = pa.array([np.array(e.ids, kind).tobytes() for e in encoded], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["word", "packed"])

    return words.mapInArrow(run, "word string, packed binary")


def word_counts(cut: DataFrame) -> DataFrame:
    """word, n: the distinct words of the lists in ``__pre``, counted per batch before they are shuffled."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            counted = pc.value_counts(batch.column(0).flatten())
            yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), counted.field(1)], ["word", "n"])

    return cut.select("__pre").where("__pre is not null").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


#: Words that travel to every executor if the table of all words is too large for it, and the longest that may (in characters).
HOT_WORDS, HOT_LENGTH = 100_000, 64
#: Occurrences of a word that did not travel above which its join is spread over salts.
HOT_ROWS = 100_000


def sent_words(words: DataFrame, counts: DataFrame, limit: int = BROADCAST_BYTES, n_hot: int = HOT_WORDS) -> tuple[DataFrame, bool]:
    """The words that are sent to every executor, and whether these are all: within ``limit`` bytes the whole table, else the ``n_hot`` most
    frequent short ones, which are most occurrences."""
    if is_within(words, limit):
        return words, True
    short = words.where(F.length("word") <= HOT_LENGTH)
    return written(short.join(counts, "word").orderBy(F.desc("n"), "word").limit(n_hot).select("word", "packed")), False


_TABLES: dict[str, tuple] = {}


def _table(name: str, shipped, width: int) -> tuple:
    """Words, offsets and ids of a broadcast table of words, laid out once per worker process."""
    import numpy as np
    import pyarrow as pa

    if name not in _TABLES:
        _TABLES.clear()
        t = pa.ipc.open_stream(shipped.value).read_all().combine_chunks()
        packed = t.column("packed").cast(pa.large_binary()).combine_chunks() if len(t) else pa.array([], pa.large_binary())
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
        ids = np.frombuffer(b"".join(packed.to_pylist()), f"<u{width}").astype("int32")
        lengths = pa.compute.binary_length(packed).to_numpy(zero_copy_only=False).astype("int64") // width
        _TABLES[name] = (pa.array(t.column("word").to_pylist(), pa.string()), np.r_[0, np.cumsum(lengths)].astype("int64"), ids)
    return _TABLES[name]


def in_place(cut: DataFrame, key: str, sent: DataFrame, width: int) -> DataFrame:
    """key, ids, rest: every list's ids; a word that was not sent leaves -1 - k, k its place in ``rest``, the document's distinct such words."""
    import pyarrow as pa

    table = sent.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    shipped, name = cut.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex

    def run(batches: Iterable) -> Iterator:
        for batch in batches:
            # Few documents at a time, so that memory follows them and not the size of a batch.
            for i in range(0, batch.num_rows, DOCS_AT_ONCE):
                yield _mapped(batch.slice(i, DOCS_AT_ONCE), *_table(name, shipped, width))

    kind = cut.schema[key].dataType.simpleString()
    return cut.select(key, "__pre").mapInArrow(run, f"{key} {kind}, ids array<int>, rest array<string>")


#: Documents put together at a time.
DOCS_AT_ONCE = 2048


def _mapped(batch, words, offsets, ids):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = batch.column(1)
    flat = lists.flatten().cast(pa.string())
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    at = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False).astype("int64")
    known = at >= 0
    count = np.where(known, np.diff(offsets)[at], 1) if len(ids) else np.ones(len(at), "int64")
    before = np.r_[0, np.cumsum(count)]
    start = np.where(known, offsets[at], 0) - before[:-1]
    take = np.repeat(start, count) + np.arange(before[-1])
    out = ids[np.where(np.repeat(known, count), take, 0)] if len(ids) else np.zeros(before[-1], "int32")
    rest: list[dict[str, int]] = [{} for _ in range(len(lists))]
    missing = np.flatnonzero(~known)
    for p, d, w in zip(missing, np.searchsorted(ends, missing, "right"), flat.take(pa.array(missing)).to_pylist(), strict=True):
        out[before[p]] = -1 - rest[d].setdefault(w, len(rest[d]))
    made = pa.ListArray.from_arrays(pa.array(np.r_[0, before[ends]].astype("int32")), pa.array(out.astype("int32")))
    return pa.RecordBatch.from_arrays([batch.column(0), made, pa.array([list(r) for r in rest], pa.list_(pa.string()))], [batch.schema.names[0], "ids", "rest"])


def filled(placed: DataFrame, key: str, words: DataFrame, hot: DataFrame, width: int) -> DataFrame:
    """key, ids: the gaps that ``in_place`` left, filled with the ids of their words, which are met in a shuffle join."""
    gaps = placed.where(F.size("rest") > 0).select(key, F.posexplode("rest").alias("k", "word"))
    found = join_hot(gaps, words, ["word"], hot, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "packed"))).alias("l"))
    both = placed.select(key, "ids").join(found.select(key, F.transform("l", lambda x: x["packed"]).alias("l")), key, "left")

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def fill(ids: list[int], packed: list[bytes] | None) -> list[int]:
            if not packed:
                return ids
            words = [np.frombuffer(p, f"<u{width}").tolist() for p in packed]
            return [y for x in ids for y in ((x,) if x >= 0 else words[-1 - x])]

        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fill(*r) for r in rows], pa.list_(pa.int32()))], [batch.schema.names[0], "ids"])

    kind = placed.schema[key].dataType.simpleString()
    return both.mapInArrow(run, f"{key} {kind}, ids array<int>")


def _once(docs: DataFrame, key: str) -> DataFrame:
    """One row per key; the shuffle of the texts is made only if some key comes twice, which its column alone tells."""
    twice = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs if twice.isEmpty() else docs.groupBy(key).agg(F.max("__text").alias("__text"))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = BROADCAST_BYTES, n_hot: int = HOT_WORDS) -> DataFrame:
    """key, ids: one row per key, an empty list for an empty or null text.

    A key names one text; repeated rows of it count once (of different texts the greatest). Special tokens' strings in a text are ordinary
    text. A word that is sent never moves; of the others each document moves every one once, and a hot one is spread over salts.
    """
    path = path or default_path()
    docs = _once(docs.select(key, F.col(text).alias("__text")), key)
    cut = written(spread(docs, key).select(key, pre_tokens(F.col("__text"), path).alias("__pre")))
    counts = written(word_counts(cut))
    words = written(encoded_words(counts.select("word"), path))
    sent, whole = sent_words(words, counts, limit, n_hot)
    placed = in_place(cut, key, sent, id_width(path))
    if whole:
        return placed.select(key, "ids")
    placed = written(placed)
    hot = counts.where(F.col("n") > HOT_ROWS).select("word").join(sent.select("word"), "word", "left_anti")
    return filled(placed, key, words, hot, id_width(path))


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, hex: the bytes of every token of the vocabulary, whose size is fixed."""
    vocabulary = load(path or default_path()).get_vocab(with_added_tokens=False)
    # Byte-level BPE writes printable bytes as themselves and moves the others up to 256 and on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in printable]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(moved)}
    rows = [(i, bytes(back[c] for c in w).hex()) for w, i in vocabulary.items() if all(c in back for c in w)]
    return spark.createDataFrame(rows, "id int, hex string")


def decode(ids: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """key, text: the text of each list of ids, '' for an empty one; ids outside the vocabulary add nothing."""
    table = F.broadcast(token_bytes(ids.sparkSession, path))
    placed = ids.select(key, F.posexplode_outer("ids").alias("pos", "id"))
    joined = placed.join(table, "id", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "hex"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["hex"]), "")
    return joined.select(key, F.decode(F.unhex(text), "UTF-8").alias("text"))

"""Byte-level BPE encoding and decoding with DuckDB inside each partition.

Encoding: the pattern cuts a text into words.  (A space before a non-space
always opens a word; pieces cut there are looked up whole, so that the pattern
runs once for each distinct piece.)  Words that the worker has not
seen yet become token-position rows; a recursive query joins neighbouring rows
with the merge table, contracts each word's leftmost pair of minimum rank, and
ends where no word has a pair left.  A text's ids are its words' ids in order.

Decoding needs the ids alone: token rows join the vocabulary, and an ordered
aggregation puts each text's bytes together.

Words of more than ``LONG_WORD`` bytes would need one recursion step for each
contraction; for them a heap takes the same pairs in the same order.

Memory is bounded: words of at most ``BLOCK_CHARS`` characters (or one text) are
held at a time, and the worker's tables of known words are emptied when full.

Defined cases: a null text is empty and has no ids; repeated rows and null ids
give rows of their own; further columns are ignored; whole texts are encoded.
The vocabulary file is read on the driver and sent to the tasks (under 1 MB).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import TEXT_ROWS, table, tidy
from linkweave.plans.scratch import Scratch

LONG_WORD = 256
BLOCK_CHARS = 1_000_000
KNOWN_WORDS = 2_000_000
#: Of a codec for one task.
TASK_WORDS = 100_000
#: Token rows that one recursive query may make: the sum of squared lengths.
QUERY_ROWS = 3_000_000

# Fixed value: the pattern whose words never cross a space before a non-space.
SPACE_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENCODE = """
WITH RECURSIVE s(n, w, p, t, next_p, next_t) AS (
  SELECT 0, w, p, t, p + 1, next_t FROM start
  UNION ALL
  SELECT s.n + 1, s.w, s.p, CASE WHEN s.p = c.p THEN c.r ELSE s.t END,
    CASE WHEN s.p = c.p THEN c.after_p ELSE s.next_p END,
    CASE WHEN s.p = c.p THEN c.after_t WHEN s.next_p = c.p THEN c.r ELSE s.next_t END
  FROM s JOIN (
    SELECT best.w, best.p, best.r, best.gone, x.next_p AS after_p, x.next_t AS after_t
    FROM (SELECT s.w, min(m.r) AS r, min_by(s.p, CAST(m.r AS BIGINT) * 1048576 + s.p) AS p,
                 min_by(s.next_p, CAST(m.r AS BIGINT) * 1048576 + s.p) AS gone
          FROM s JOIN merges m ON m.a = s.t AND m.b = s.next_t GROUP BY s.w) best
    JOIN s x ON x.w = best.w AND x.p = best.gone) c ON c.w = s.w
  WHERE s.p <> c.gone),
last AS (SELECT w, max(n) AS n FROM s GROUP BY w)
SELECT w, t FROM s JOIN last USING (w, n) ORDER BY w, p
"""
DECODE = "SELECT d, array_to_string(list(hex ORDER BY p), '') AS hex FROM tokens JOIN vocabulary USING (id) GROUP BY d ORDER BY d"


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """Encodes and decodes with one vocabulary; holds its own database."""

    def __init__(self, data: bytes, pattern: str, most_known: int = KNOWN_WORDS):
        import duckdb
        import regex

        self.ranks = read_ranks(data)
        self.words_of = regex.compile(pattern).findall
        self.cut_safely = pattern == SPACE_LED
        self.odd_space = re.compile(r" (?:\s|\Z)").search
        #: Ids of words and of pieces alike.
        self.known: dict[str, bytes] = {}
        self.most_known = most_known
        ids = np.array(list(self.ranks.values()), dtype=np.int32)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '160MB'; SET preserve_insertion_order = false")
        self.merges = {}
        for b, r in self.ranks.items():
            for i in range(1, len(b)):
                if (x := self.ranks.get(b[:i])) is not None and (y := self.ranks.get(b[i:])) is not None:
                    self.merges[x, y] = r
        a, b = zip(*self.merges, strict=True) if self.merges else ((), ())
        self._table("merges", a=pa.array(a, pa.int32()), b=pa.array(b, pa.int32()), r=pa.array(self.merges.values(), pa.int32()))
        self._table("vocabulary", id=pa.array(ids), hex=pa.array([b.hex() for b in self.ranks]))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def heap_ids(self, word: bytes) -> list[int]:
        """The same contractions for one long word: a heap of pairs by rank, then place."""
        ids = self.byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, back = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < len(ids):
                back[after[i]] = i
            for x, y in ((back[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (n := self.merges.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (n, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def _recursive(self, words: list[str], raw: list[bytes]) -> None:
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        w = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        p = (np.arange(len(flat)) - np.repeat(starts, sizes)).astype(np.int32)
        t = self.byte[flat]
        after = np.append(t[1:], -1)
        after[starts + sizes - 1] = -1
        self.db.register("start", pa.table({"w": w, "p": p, "t": t, "next_t": after.astype(np.int32)}))
        out = self.db.sql(ENCODE).to_arrow_table()
        self.db.unregister("start")
        cuts = (np.searchsorted(out["w"].to_numpy(), np.arange(len(raw) + 1)) * 4).tolist()
        ids = out["t"].to_numpy().astype("<u4").tobytes()
        self.known.update(zip(words, (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))

    def learn(self, words: set[str]) -> None:
        """Put the ids of all these words into ``known``."""
        todo, raw, cost = [], [], 0
        for word in words:
            if word in self.known:
                continue
            b = word.encode()
            if (r := self.ranks.get(b)) is not None:
                self.known[word] = np.array([r], dtype="<u4").tobytes()
            elif len(b) > LONG_WORD:
                self.known[word] = np.array(self.heap_ids(b), dtype="<u4").tobytes()
            else:
                todo.append(word)
                raw.append(b)
                cost += len(b) ** 2
                if cost > QUERY_ROWS:
                    self._recursive(todo, raw)
                    todo, raw, cost = [], [], 0
        if todo:
            self._recursive(todo, raw)

    def pieces_of(self, text: str) -> list[str]:
        """The text cut where it surely begins a word: at a space before anything but white space."""
        if self.odd_space(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else [*map(" ".__add__, rest)]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            held, chars = [], 0
            while at < len(texts) and (not held or chars + len(texts[at]) <= BLOCK_CHARS):
                held.append(self.pieces_of(texts[at]) if self.cut_safely and texts[at] else [texts[at]])
                chars += len(texts[at])
                at += 1
            pieces = set().union(*held)
            if len(self.known) + len(pieces) > self.most_known:
                self.known = {}
            new = [x for x in pieces if x not in self.known]
            if self.cut_safely:  # letters after an optional space are one word
                single = [x for x in new if x[1:].isalpha() and x[0] == " "]
                mixed = [x for x in new if not (x[1:].isalpha() and x[0] == " ")]
                words = [self.words_of(x) for x in mixed]
            else:
                mixed, words, single = new, [self.words_of(x) for x in new], []
            self.learn(set(single).union(*words))
            known = self.known.__getitem__
            self.known.update([(x, b"".join(map(known, ws))) for x, ws in zip(mixed, words, strict=True)])
            for ps in held:
                yield b"".join(map(known, ps))

    def decode_all(self, many: list[bytes]) -> Iterator[bytes]:
        """The bytes that each text's ids stand for: an ordered aggregation of its tokens."""
        at = 0
        while at < len(many):
            end, size = at + 1, len(many[at])
            while end < len(many) and size + len(many[end]) <= BLOCK_CHARS:
                size += len(many[end])
                end += 1
            tokens = np.frombuffer(b"".join(many[at:end]), dtype="<u4").astype(np.int32)
            owner = np.repeat(np.arange(end - at, dtype=np.int32), [len(x) // 4 for x in many[at:end]])
            self.db.register("tokens", pa.table({"d": owner, "p": np.arange(len(tokens), dtype=np.int32), "id": tokens}))
            out = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            found = dict(zip(out["d"].to_pylist(), out["hex"].to_pylist(), strict=True))
            for i in range(end - at):
                yield bytes.fromhex(found.get(i, ""))
            at = end


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker, whichever tasks it runs."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The rank file's bytes and the pattern; by default the public 50k vocabulary's."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), pattern or public_tokenizers.PATTERN


def encode_column(df: DataFrame, keep: list[str], path: str | None = None, pattern: str | None = None, digests: bool = False, reuse: bool = True) -> DataFrame:
    """Columns ``keep`` of ``df`` (longs or strings) and the text's ids.

    With ``reuse`` a Python worker keeps its codec and known words for its next
    tasks: up to a third less work, up to 400 MB held between tasks.  Without,
    each task has a codec of its own with fewer known words, closed at its end,
    and the rows are written to the shared folder, few texts in an Arrow batch.

    With ``digests`` only: n_tokens, ids_sha256, decoded_sha256; else also
    ``ids`` (packed little-endian unsigned 32-bit integers).
    """
    given = df.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))
    names = [*keep, *([] if digests else ["ids"]), "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*given.value) if reuse else Codec(*given.value, TASK_WORDS)
        try:
            yield from coded(codec, batches)
        finally:
            if not reuse:
                codec.db.close()
                codec.known = {}

    def coded(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = list(codec.encode_all([x or "" for x in part.column(part.num_columns - 1).to_pylist()]))
                back = list(codec.decode_all(ids))
                cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                own = [] if digests else [pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *own, *cols], names=names)

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), *([] if digests else ["ids binary"]), "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    out = df.select(*keep, F.col("text").alias("__text")).mapInArrow(tidy(run), schema)
    return out if reuse else Scratch(df.sparkSession, "bpe").write(out, "encoded", TEXT_ROWS)


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), ["doc_id"], digests=True)

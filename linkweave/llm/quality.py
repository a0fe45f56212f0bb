"""Quality by the perplexity of an n-gram model of trusted text.

An interpolated modified Kneser-Ney trigram model is trained for each language
on documents labelled as good.  Its units are the words that occur at least
``LEAST_COUNT`` times in a language's training text, so that vocabulary and
trigrams grow with it.  For other words a class by case, characters and length,
or by repeating the word before, stands in.

1. The words of the training documents are counted (by hash codes of at most
   ``CODES`` values over all languages together, which bounds what is sent to
   the driver and the tasks); a word's number is its rank.
2. All texts become numbers, in blocks of at most ``BLOCK`` tokens of one
   language.  Blocks are bucketed by their own number, so that answers come back
   to them without moving them.
3. The distinct trigrams of a block are dealt into shards by their middle word,
   as sorted and packed arrays; a middle word with more than ``SHARD`` tokens is
   dealt into several by the word before, and its bigram counts, at most one for
   each word of the vocabulary, are summed up and given to each of them.  So all
   counts that a trigram's probability needs are in its shard, but for the
   counts of single words.
4. Each shard answers each block with one array of log probabilities, rounded to
   ``STEP``; a document's mean gives its perplexity.

Of the trusted documents one in ``HOLD`` is kept out of training.  A language's
limit is the ``QUANTILE`` of their log perplexities, each one drawn towards the
language's median as if it had ``PRIOR`` further tokens with that value, so that
a text of few words has to be stranger to be rejected.  A language with fewer
than ``LEAST_HELD`` such documents takes the deviations from the median of all
languages' documents together; where these are fewer too, the limit lies at
least three times as far from the median as their 0.84 quantile.

Defined cases: a null text is empty; an empty text is scored by its end alone;
texts of any length are scored whole; a null language is a language of its own,
the one with an empty name; documents of a language without trusted text have
no perplexity and are kept; every input row gives one row, repeated rows equal
ones; several labels of one id count as their highest; labels and ids that are
null don't count; words of equal count are ranked by code; a document exactly
at the threshold is kept; empty tables give no rows; further columns, whatever
their names, are ignored (``keep_good`` returns them).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import TEXT_ROWS, release, table, tidy, without
from linkweave.plans.scratch import Scratch

#: Occurrences in a language's training text from which a word is a unit of its own.
LEAST_COUNT = 2
#: Of the trusted documents one in so many sets the threshold instead of training.
HOLD = 5
QUANTILE = 0.995
#: Tokens with a language's median that are added to each document, and held out documents that a language needs for a quantile of its own.
PRIOR = 20
LEAST_HELD = 200
#: Tokens in a block, distinct words that a task counts at once, tokens looked at together, and tokens of a language for each of its shards.
BLOCK = 3_000_000
WORDS = 200_000
PIECE = 500_000
SHARD = 8_000_000
#: Log probabilities are handed over as whole multiples of this.
STEP = 1 / 16
#: Codes of all languages together: 12 bytes each.
CODES = 1 << 23
#: Trusted ids up to which they are sent to the tasks (8 bytes each); more are joined.
FEW_TRUSTED = 4_000_000
#: Languages up to which a table with one row for each is broadcast.
FEW_LANGUAGES = 10_000
#: Codes with this share of a block's tokens are reported, so that shards of frequent words can be split.
FREQUENT = 1 / 256

#: Discounts are at least this, so that even small tables leave something for unseen trigrams.
LEAST_DISCOUNT = 0.1

START, END, REPEAT = 0, 1, 2
CLASSES = 3 + 4 * 3 * 6
BITS = 21
MASK = (1 << BITS) - 1


def word_class(word: str) -> int:
    """Class of a word outside the vocabulary: case, characters, length."""
    case = 0 if word.isupper() and len(word) > 1 else 1 if word[0].isupper() else 2 if word.islower() else 3
    form = 0 if word.isalpha() else 1 if word[:-1].isalpha() and word[-1] in ".,;:?" else 2
    return 3 + (case * 3 + form) * 6 + min(len(word), 20) // 4


def codes_of(words: list[str], codes: int) -> np.ndarray:
    """Hash codes of words: whole numbers below ``codes``."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return (np.fromiter((h(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words)) % np.uint64(codes)).astype(np.int64)


def codes_for(languages: int) -> int:
    """Codes that each of so many languages has, classes left room for."""
    return max(1, min(1 << BITS, CODES // max(1, languages)) - CLASSES)


# -- packed arrays -------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())


def unpack(x: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, len(raw) // np.dtype(kind).itemsize).T).view(kind).ravel()


def _falls(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Differences within runs; a run's first value as it is."""
    return np.where(begins, x, np.diff(x, prepend=0))


def _rises(d: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.cumsum(d)
    return total - (total - d)[begins][np.cumsum(begins) - 1]


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct trigrams by the differences of each word within equal words before it."""
    a, b, c = keys >> 2 * BITS, (keys >> BITS) & MASK, keys & MASK
    new_a = np.diff(a, prepend=-1) != 0
    new_b = new_a | (np.diff(b, prepend=-1) != 0)
    return pack(np.concatenate([np.diff(a, prepend=0), _falls(b, new_a), _falls(c, new_b)]).astype(np.int32))


def unpack_keys(x: bytes) -> np.ndarray:
    da, db, dc = unpack(x, np.int32).reshape(3, -1).astype(np.int64)
    if not len(da):
        return da
    new_a = da != 0
    new_a[0] = True
    new_b = new_a | (db != 0)
    return (np.cumsum(da) << 2 * BITS) | (_rises(db, new_a) << BITS) | _rises(dc, new_b)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0).astype(np.int32))


def unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x, np.int32).astype(np.int64))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, sorted."""
    return _distinct_in_place(x.copy())


def _distinct_in_place(x: np.ndarray) -> np.ndarray:
    x.sort()
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _split_by(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with its places, in order."""
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(group[at[0]]), at


def _summed_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, with the sums of their counts."""
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    return own, np.bincount(at, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)


def _row(values: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)


# -- words and blocks -----------------------------------------------------------


def _word_counts(trusted, codes: int):
    """Rows (lang, part, codes, n) of the words of training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                own, n = _summed_up([codes_of(list(words), codes)], [np.fromiter(words.values(), dtype=np.int64, count=len(words))])
                for p, at in _split_by(own >> 18):
                    yield _row([lang, p, pack_sorted(own[at]), pack(n[at])], [pa.string(), pa.int32(), pa.binary(), pa.binary()], ["lang", "part", "codes", "n"])
            held.clear()

        for batch in batches:
            train = trusted(batch)
            for lang, text in zip(batch.column(1).filter(train).to_pylist(), batch.column(2).filter(train), strict=True):
                held.setdefault(lang, Counter()).update(text.as_py().split())
                if sum(map(len, held.values())) > WORDS:
                    yield from counted()
        yield from counted()

    return run


def _words_summed(least: int):
    def run(group: pa.Table) -> pa.Table:
        own, n = _summed_up([unpack_sorted(x.as_py()) for x in group["codes"]], [unpack(x.as_py(), np.int64) for x in group["n"]])
        own, n = own[n >= least], n[n >= least]
        return pa.table({"lang": [group["lang"][0].as_py()], "codes": pa.array([pack_sorted(own)], pa.binary()), "n": pa.array([pack(n)], pa.binary())})

    return run


class Places(dict):
    """Numbers words by when they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Vocabulary:
    """Ranks of a language's words by their codes."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        order = np.argsort(codes)
        self.codes, n = codes[order].astype(np.int32), n[order]
        self.rank = np.empty(len(n), dtype=np.int32)
        self.rank[np.lexsort((self.codes, -n))] = np.arange(CLASSES, CLASSES + len(n))

    def __getstate__(self) -> tuple[bytes, bytes]:
        return pack_sorted(self.codes), pack(self.rank)

    def __setstate__(self, packed: tuple[bytes, bytes]) -> None:
        self.codes, self.rank = unpack_sorted(packed[0]).astype(np.int32), unpack(packed[1], np.int32)

    def numbers(self, words: list[str], codes: int) -> np.ndarray:
        """Each word's rank, or its class if it has none."""
        own = codes_of(words, codes)
        at, there = _at(self.codes, own)
        out = self.rank[at] if len(self.codes) else np.zeros(len(words), dtype=np.int32)
        rest = np.flatnonzero(~there)
        out[rest] = [word_class(words[i]) for i in rest.tolist()]
        return out


BLOCK_COLUMNS = "block long, lang string, ids array<long>, sizes array<int>, train binary, codes binary, often array<int>, often_n array<long>, tokens long"


def _coding(trusted, vocabulary, codes: int):
    """Blocks of documents of one language; without a vocabulary their words aren't numbered."""
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
    names = [c.split()[0] for c in BLOCK_COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, number = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}
        lists: dict[str, Places] = {}
        size: dict[str, int] = {}

        def block(lang: str) -> pa.RecordBatch:
            nonlocal number
            ids, train, docs = zip(*held.pop(lang), strict=True)
            words, n = lists.pop(lang), size.pop(lang)
            number += 1
            sizes, often, x = [len(d) for d in docs], np.empty(0, dtype=np.int64), b""
            if lang in vocabulary.value:
                at = np.concatenate(docs)
                own = vocabulary.value[lang].numbers(list(words), codes)
                x = own[at] if len(own) else np.empty(0, dtype=np.int32)
                first = np.zeros(n + 1, dtype=bool)
                first[np.concatenate([[0], np.cumsum(sizes)])] = True
                again = np.zeros(n, dtype=bool)
                again[1:] = (at[1:] == at[:-1]) & (x[1:] < CLASSES) & ~first[1:-1]
                x[again] = REPEAT
                often = np.bincount(x)
                x = pack(x)
            top = np.flatnonzero(often > n * FREQUENT)
            return _row([(pid << 32) + number, lang, list(ids), sizes, np.packbits(train).tobytes(), x, top.tolist(), often[top].tolist(), n], kinds, names)

        for batch in batches:
            train = trusted(batch).to_pylist()
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc, lang, text, good in zip(*(part.column(i).to_pylist() for i in range(3)), train[start : start + 256], strict=True):
                    at = lists.setdefault(lang, Places())
                    found = text.split()
                    held.setdefault(lang, []).append((doc, good, np.fromiter(map(at.__getitem__, found), dtype=np.int32, count=len(found))))
                    size[lang] = size.get(lang, 0) + len(found)
                    if size[lang] >= BLOCK:
                        yield block(lang)
        for lang in list(held):
            yield block(lang)

    return run


def trigrams(ids: np.ndarray) -> np.ndarray:
    """Packed trigrams of one document's numbers, its start and end included: middle, first, last word."""
    return block_trigrams(ids, np.array([len(ids)]))


def block_trigrams(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Packed trigrams of all documents in order: one more for each than it has words."""
    out, at = np.empty(len(ids) + len(sizes), dtype=np.int64), 0
    for begin, n in _pieces(sizes):
        first = int(sizes[:begin].sum())
        part = _trigrams(ids[first : first + int(sizes[begin : begin + n].sum())], sizes[begin : begin + n])
        out[at : at + len(part)] = part
        at += len(part)
    return out


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents (first, number) with about ``PIECE`` tokens, so that large arrays of a block are few."""
    of = np.cumsum(sizes) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(sizes)]
    return ((a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _trigrams(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    x = np.full(len(ids) + 3 * len(sizes), START, dtype=np.int64)
    ends = np.cumsum(sizes + 3) - 1
    place = np.arange(len(ids)) + 2 + 3 * np.repeat(np.arange(len(sizes)), sizes)
    x[place], x[ends] = ids, END
    last = np.ones(len(x), dtype=bool)
    begins = ends - sizes - 2
    last[begins], last[begins + 1] = False, False
    at = np.flatnonzero(last)
    return (x[at - 1] << 2 * BITS) | (x[at - 2] << BITS) | x[at]


# -- shards ---------------------------------------------------------------------


def shard_of(keys: np.ndarray, shards: int, split: dict[int, int] | None = None) -> np.ndarray:
    """Shard of each trigram, by its middle word; a split word's by the word before too."""
    b = keys >> 2 * BITS
    mixed = b * 0x9E3779B1
    if split:
        words = np.array(sorted(split))
        at, there = _at(words, b)
        parts = np.where(there, np.array([split[w] for w in words.tolist()])[at], 1)
        mixed = mixed + ((keys >> BITS & MASK) * 0x85EBCA6B >> 9) % parts * 0xC2B2AE35
    return ((mixed >> 7) % shards).astype(np.int32)


def _dealt(shards: dict[str, int], split: dict[str, dict[int, int]], train: bool):
    """Rows (lang, shard, block, keys, n) of a block's distinct trigrams; for training with their counts."""
    kinds, names = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["lang", "shard", "block", "keys", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, sizes, good, codes in zip(*batch.columns, strict=True):
                own = lang.as_py()
                if own not in shards:
                    continue
                keys, n = block_trigrams(unpack(codes.as_py(), np.int32), np.array(sizes.values, dtype=np.int64)), None
                if train:
                    wanted = np.unpackbits(np.frombuffer(good.as_py(), dtype=np.uint8), count=len(sizes.values)).astype(bool)
                    keys, n = np.unique(keys[np.repeat(wanted, np.array(sizes.values, dtype=np.int64) + 1)], return_counts=True)
                else:
                    keys = _distinct_in_place(keys)
                for i, here in _split_by(shard_of(keys, shards[own], split.get(own))):
                    yield _row([own, i, block.as_py(), pack_keys(keys[here]), pack(n[here].astype(np.int32)) if train else None], kinds, names)

    return run


def _few(n: np.ndarray) -> list[int]:
    """How many occur once, twice, three and four times."""
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def _pair(keys: np.ndarray) -> np.ndarray:
    """Middle and last word of trigrams."""
    return (keys >> 2 * BITS << BITS) | (keys & MASK)


def _pairs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of middle and last words, and after how many words each one was seen."""
    return np.unique(_pair(keys), return_counts=True)


MODEL = "lang string, shard int, block long, keys binary, n binary, few3 array<long>, few2 array<long>, last binary, last_n binary, pairs binary, pairs_n binary"


def _model_table(**columns) -> pa.Table:
    out = {}
    for spec in MODEL.split(", "):
        name, kind = spec.split()
        t = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[kind]
        out[name] = pa.array([columns.get(name)], t)
    return pa.table(out)


def _bigram_statistics(pairs: np.ndarray, n2: np.ndarray) -> dict:
    last, n1 = np.unique(pairs & MASK, return_counts=True)
    return {"few2": _few(n2), "last": pack_sorted(last), "last_n": pack(n1.astype(np.int32))}


def _summed(split: dict[str, dict[int, int]]):
    """A shard's counts with the statistics of its trigrams and whole bigrams; bigrams of split words apart."""

    def run(group: pa.Table) -> pa.Table:
        lang = group["lang"][0].as_py()
        keys, n = _summed_up([unpack_keys(x.as_py()) for x in group["keys"]], [unpack(x.as_py(), np.int32) for x in group["n"]])
        pairs, n2 = _pairs_of(keys)
        part = np.isin(pairs >> BITS, list(split.get(lang, ())))
        more = {"pairs": pack_keys(pairs[part]), "pairs_n": pack(n2[part].astype(np.int32))} if part.any() else {}
        return _model_table(lang=lang, shard=group["shard"][0].as_py(), block=-1, keys=pack_keys(keys), n=pack(n), few3=_few(n), **_bigram_statistics(pairs[~part], n2[~part]), **more)

    return run


def _statistics_summed(group: pa.Table) -> pa.Table:
    """The statistics of several shards of a language, added up."""
    last, n1 = _summed_up([unpack_sorted(x.as_py()) for x in group["last"]], [unpack(x.as_py(), np.int32) for x in group["last_n"]])
    few = {c: np.sum([x.as_py() for x in group[c] if x.is_valid] or [[0] * 4], axis=0).tolist() for c in ("few3", "few2")}
    out = _model_table(lang=group["lang"][0].as_py(), shard=0, last=pack_sorted(last), last_n=pack(n1.astype(np.int32)), **few)
    return out.select(["lang", "shard", "few3", "few2", "last", "last_n"])


def _split_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bigrams of split words, a row for each word of a shard."""
    for batch in batches:
        for lang, pairs, n in zip(*batch.columns, strict=True):
            pairs, n = unpack_keys(pairs.as_py()), unpack(n.as_py(), np.int32)
            for w, at in _split_by(pairs >> BITS):
                yield _row([lang.as_py(), w, pack_keys(pairs[at]), pack(n[at])], [pa.string(), pa.int32(), pa.binary(), pa.binary()], ["lang", "shard", "pairs", "pairs_n"])


def _split_summed(group: pa.Table) -> pa.Table:
    """All bigrams of a split word; the word is in the place of the shard."""
    pairs, n2 = _summed_up([unpack_keys(x.as_py()) for x in group["pairs"]], [unpack(x.as_py(), np.int32) for x in group["pairs_n"]])
    return _model_table(lang=group["lang"][0].as_py(), shard=group["shard"][0].as_py(), block=-2, pairs=pack_keys(pairs), pairs_n=pack(n2.astype(np.int32)), **_bigram_statistics(pairs, n2))


def discounts_of(few: list[int]) -> np.ndarray:
    """Discounts of what occurs once, twice and more often, from the counts of 1 to 4 occurrences."""
    n = [max(x, 1) for x in few]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([max(LEAST_DISCOUNT, min(i, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)])


class Single(tuple):
    """Sorted words, their probabilities, and that of any other; goes to the tasks packed."""

    def __reduce__(self):
        return _single, (pack_sorted(self[0]), pack(self[1].astype(np.float32)), self[2])


def _single(words: bytes, p: bytes, other: float) -> Single:
    return Single((unpack_sorted(words).astype(np.int32), unpack(p, np.float32).astype(np.float64), other))


def single_words(last: np.ndarray, n1: np.ndarray) -> Single:
    """Probabilities of single words from the number of words that each was seen after."""
    off = discounts_of(_few(n1))[np.minimum(n1, 3) - 1]
    other = max(float(off.sum()), 0.5) / n1.sum() / (len(n1) + 1)
    return Single((last.astype(np.int32), ((n1 - off) / n1.sum() + other).astype(np.float64), float(other)))


def _at(own: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the asked values in a sorted array, and which are there."""
    if not len(own):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
    return at, own[at] == asked


def log_probabilities(keys: np.ndarray, n: np.ndarray, single: Single, d2: np.ndarray, d3: np.ndarray, whole: tuple[np.ndarray, np.ndarray] | None = None):
    """Function from asked trigrams of a shard to their log probabilities.

    ``single`` is as ``single_words`` gives it; ``whole`` has the sorted bigrams
    of split words and their counts, which replace those seen in this shard.
    """
    pairs, n2 = _pairs_of(keys)
    if whole is not None:
        rest = ~np.isin(pairs >> BITS, _distinct(whole[0] >> BITS))
        pairs, n2 = np.concatenate([pairs[rest], whole[0]]), np.concatenate([n2[rest], whole[1]])
        order = np.argsort(pairs)
        pairs, n2 = pairs[order], n2[order]
    off3, off2 = d3[np.minimum(n, 3) - 1], d2[np.minimum(n2, 3) - 1]
    ab, at3 = np.unique(keys >> BITS, return_inverse=True)
    t3, g3 = np.bincount(at3, weights=n), np.bincount(at3, weights=off3)
    b, at2 = np.unique(pairs >> BITS, return_inverse=True)
    t2, g2 = np.bincount(at2, weights=n2), np.bincount(at2, weights=off2)
    x3, x2 = (n - off3) / t3[at3], (n2 - off2) / t2[at2]

    def asked(q: np.ndarray) -> np.ndarray:
        at, there = _at(single[0], (q & MASK).astype(np.int32))
        p = np.where(there, single[1][at], single[2])
        for own, x, contexts, rest, pair in ((pairs, x2, b, g2 / t2, _pair(q)), (keys, x3, ab, g3 / t3, q)):
            if len(own):
                at, there = _at(contexts, pair >> BITS)
                p = p * np.where(there, rest[at], 1.0)
                at, there = _at(own, pair)
                p += np.where(there, x[at], 0.0)
        return np.log(p)

    return asked


def _answers(model):
    """Rows (block, shard, logs) of a shard, one for each block that asks."""

    def run(own: pa.Table, group: pa.Table) -> pa.Table:
        release()
        rows = []
        if group.num_rows:
            lang, block = group["lang"][0].as_py(), group["block"].to_numpy()
            keys, n, whole = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), None
            if own.num_rows:
                keys, n = unpack_keys(own["keys"][0].as_py()), unpack(own["n"][0].as_py(), np.int64)
            if (split := np.flatnonzero(block < 0)).size:
                whole = _summed_up([unpack_keys(group["keys"][i].as_py()) for i in split.tolist()], [unpack(group["n"][i].as_py(), np.int32) for i in split.tolist()])
            of, shard = log_probabilities(keys, n, *model.value[lang], whole), group["shard"][0].as_py()
            rows = [(int(block[i]), shard, pack(np.rint(of(unpack_keys(group["keys"][i].as_py())) / STEP).astype(np.int16))) for i in np.flatnonzero(block >= 0).tolist()]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["block", "shard", "logs"])

    return run


def _perplexities(shards: dict[str, int], split: dict[str, dict[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, ids, sizes, codes, answers in zip(*batch.columns, strict=True):
                own, n = lang.as_py(), np.array(sizes.values, dtype=np.int64)
                mean = pa.nulls(len(n), pa.float64())
                if own in shards:
                    x = unpack(codes.as_py(), np.int32)
                    keys = _distinct_in_place(block_trigrams(x, n))
                    logs = np.empty(len(keys), dtype=np.float32)
                    each = sorted((x["shard"], x["logs"]) for x in answers.as_py())
                    logs[np.argsort(shard_of(keys, shards[own], split.get(own)), kind="stable")] = np.concatenate([unpack(x, np.int16) for _, x in each]) * STEP
                    total, ends = [], np.cumsum(n)
                    for begin, many in _pieces(n):
                        own_n = n[begin : begin + many]
                        part = _trigrams(x[ends[begin] - n[begin] : ends[begin + many - 1]], own_n)
                        order = np.argsort(part)
                        own_logs = np.empty(len(part))
                        own_logs[order] = logs[np.searchsorted(keys, part[order])]
                        total.append(np.add.reduceat(own_logs, np.cumsum(own_n + 1) - own_n - 1))
                    mean = pa.array(-np.concatenate(total) / (n + 1))
                yield pa.RecordBatch.from_arrays([ids.values, pa.array([own] * len(n), pa.string()), pa.array(n), mean], names=["doc_id", "lang", "n_tokens", "surprise"])

    return run


# -- the whole ------------------------------------------------------------------


def _trusted(good: DataFrame, rows: DataFrame) -> tuple[DataFrame, object]:
    """The rows, and a function that tells a batch's training documents.

    Few ids are sent to the tasks; with more the rows are joined with them.
    """
    ids = good.filter("NOT hold").select("doc_id")
    if ids.count() > FEW_TRUSTED:
        rows = rows.join(ids.withColumn("train", F.lit(True)), "doc_id", "left").select("doc_id", "lang", "text", F.coalesce("train", F.lit(False)).alias("train"))
        return rows, lambda batch: batch.column(3)
    known = rows.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow()["doc_id"].to_numpy()))

    def has(batch: pa.RecordBatch) -> pa.Array:
        there = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        return pa.array(there & _at(known.value, batch.column(0).fill_null(0).to_numpy())[1])

    return rows, has


def score_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least: int = LEAST_COUNT) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold and kept of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    share = spark.sparkContext.broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).dropna().groupBy("doc_id").agg(F.max("q").alias("q")).filter("q > 0")
    good = scratch.write(good.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(HOLD)) == 0).alias("hold")), "good")
    rows, trusted = _trusted(good, rows)

    languages = rows.select("lang").distinct().count()
    codes = codes_for(languages)
    counted = rows.mapInArrow(tidy(_word_counts(trusted, codes)), "lang string, part int, codes binary, n binary").groupBy("lang", "part").applyInArrow(_words_summed(least), "lang string, codes binary, n binary")
    words: dict[str, list] = {}
    for lang, own, n in scratch.write(counted, "words", TEXT_ROWS).collect():
        words.setdefault(lang, []).append((unpack_sorted(own), unpack(n, np.int64)))
    vocabulary = share({lang: Vocabulary(*map(np.concatenate, zip(*x, strict=True))) for lang, x in words.items()})
    del words

    blocks = scratch.write_bucketed(rows.mapInArrow(tidy(_coding(trusted, vocabulary, codes)), BLOCK_COLUMNS), ["block"], "blocks", TEXT_ROWS)
    tokens = dict(blocks.filter(F.col("lang").isin(list(vocabulary.value))).groupBy("lang").agg(F.sum("tokens")).collect()) if vocabulary.value else {}
    shards = {lang: max(1, -(-n // SHARD)) for lang, n in tokens.items()}
    often = blocks.select("lang", F.explode(F.arrays_zip("often", "often_n")).alias("x")).groupBy("lang", "x.often").agg(F.sum("x.often_n").alias("n")).filter(F.col("n") > SHARD)
    split: dict[str, dict[int, int]] = {}
    for lang, word, n in often.collect():  # of each language fewer than 256
        split.setdefault(lang, {})[word] = -(-n // SHARD)

    packed = "lang string, shard int, block long, keys binary, n binary"
    dealt = lambda train: blocks.select("block", "lang", "sizes", "train", "codes").mapInArrow(tidy(_dealt(shards, split, train)), packed)
    model = scratch.write_bucketed(dealt(True).groupBy("lang", "shard").applyInArrow(_summed(split), MODEL), ["lang", "shard"], "model")
    if split:
        apart = model.filter("pairs IS NOT NULL").select("lang", "pairs", "pairs_n").mapInArrow(_split_dealt, "lang string, shard int, pairs binary, pairs_n binary")
        apart = scratch.write(apart.groupBy("lang", "shard").applyInArrow(_split_summed, MODEL), "split")
    statistics = "lang string, shard int, few3 array<long>, few2 array<long>, last binary, last_n binary"
    each = (model.unionByName(apart) if split else model).select(*[c.split()[0] for c in statistics.split(", ")])
    for key in ([F.col("lang"), F.pmod("shard", F.lit(64)).alias("some")], [F.col("lang")]):  # in two steps, as there may be many shards
        each = each.groupBy(*key).applyInArrow(_statistics_summed, statistics)
    given = share({lang: (single_words(unpack_sorted(last), unpack(n1, np.int32)), discounts_of(few2), discounts_of(few3)) for lang, few3, few2, last, n1 in each.select("lang", "few3", "few2", "last", "last_n").collect()})

    del each
    scratch.sweep()
    asked = dealt(False)
    if split:
        places = spark.createDataFrame([(lang, word, i) for lang, x in split.items() for word, k in x.items() for i in _places(word, k, shards[lang])], "lang string, word int, at int")
        whole = apart.select("lang", F.col("shard").alias("word"), F.col("pairs").alias("keys"), F.col("pairs_n").alias("n")).join(places, ["lang", "word"])
        asked = asked.unionByName(whole.select("lang", F.col("at").alias("shard"), F.lit(-2).cast("long").alias("block"), "keys", "n"))
    answers = model.select("lang", "shard", "keys", "n").groupBy("lang", "shard").cogroup(asked.groupBy("lang", "shard")).applyInArrow(_answers(given), "block long, shard int, logs binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "logs")).alias("answers"))
    scored = blocks.select("block", "lang", "ids", "sizes", "codes").join(answers, "block", "left")
    scored = scratch.write(scored.select("lang", "ids", "sizes", "codes", "answers").mapInArrow(tidy(_perplexities(shards, split)), "doc_id long, lang string, n_tokens long, surprise double"), "scored")
    scratch.drop(blocks)
    scratch.drop(model)
    return _judged(scored, good, quantile, scratch, F.broadcast if languages <= FEW_LANGUAGES else lambda df: df)


def _places(word: int, parts: int, shards: int) -> list[int]:
    """The shards that may hold trigrams with this middle word."""
    return sorted({((word * 0x9E3779B1 + i * 0xC2B2AE35) >> 7) % shards for i in range(parts)})


def _judged(scored: DataFrame, good: DataFrame, quantile: float, scratch: Scratch, small) -> DataFrame:
    """Perplexity, threshold and kept of scored rows, by the held out ones' quantiles."""
    held = scratch.write(scored.dropna(subset=["surprise"]).join(good.filter("hold").select("doc_id"), "doc_id").select("lang", "n_tokens", "surprise"), "held")
    middle = scratch.write(held.groupBy("lang").agg(F.percentile_approx("surprise", 0.5, 100_000).alias("middle"), F.count("*").alias("n")), "middle")
    drawn = (F.col("surprise") - F.col("middle")) * (F.col("n_tokens") + 1) / (F.col("n_tokens") + 1 + PRIOR)
    off = scratch.write(held.join(small(middle), "lang").select("lang", drawn.alias("off")), "off")
    top = lambda: F.percentile_approx("off", quantile, 100_000)
    together, sigma, n = off.agg(top(), F.percentile_approx("off", 0.84, 100_000), F.count("*")).first()
    if 0 < n < LEAST_HELD:  # the largest of few is too small
        together = max(together, 3 * sigma)
    own = off.groupBy("lang").agg(top().alias("own")).join(middle, "lang")
    limits = own.select("lang", "middle", F.when(F.col("n") >= LEAST_HELD, F.col("own")).otherwise(F.lit(together)).alias("off"))
    limit = F.col("middle") + F.col("off") * (F.col("n_tokens") + 1 + PRIOR) / (F.col("n_tokens") + 1)
    out = scored.join(small(scratch.write(limits, "limits")), "lang", "left")
    kept = F.coalesce(F.col("surprise") <= limit, F.lit(True))
    return out.select("doc_id", "lang", "n_tokens", F.exp("surprise").alias("perplexity"), F.exp(limit).alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` without the rejected ones; same columns.

    Rows with a null id are kept: a rejection couldn't name them.
    """
    bad = score_quality(docs, labels, quantile).filter("NOT kept").select("doc_id").distinct()
    return without(docs, Scratch(docs.sparkSession, "rejected").write(bad, "ids"))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Token ids in Simple-8b words, in ascending document order.

A section holds whole documents. Its ids are cut into blocks of 128; each
block is packed greedily into 64-bit words, whose top four bits select how
many ids of how many bits follow (60 of 1 bit down to 1 of 60 bits). Ids of
more than 60 bits escape: selector 15, then the id in a word of its own. The
offset of each block's first word is stored, so blocks decode independently.

Section layout (little-endian): "S8B1", number of documents, ids, blocks and
words (u64 each), document ids (i64), null flags (u8), lengths (u64), block
offsets (u64), words (u64). Sections are the rows of a Parquet table (part,
seq, within: the ids of the part before the section, n_ids, section), which
gives them an atomic commit and a store that every executor can reach. The
table stays where it was written; a section starts at the ids of all parts
before its own, plus ``within``.
"""

from __future__ import annotations

import string
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import lean, mix64, ready_python, shared_dir

BLOCK = 128
#: Ids in a word, and bits of each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
_PAYLOAD = np.uint64((1 << 60) - 1)
SECTION_IDS = 1 << 18
GROUP_BYTES = 2 << 20
SECTIONS = "part int, seq int, within long, n_ids long, section binary"
CACHED_WORDS = 2_000_000
LONGEST = 256
_PUNCTUATION = string.punctuation.encode()
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
with np.errstate(over="ignore"):
    _BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ALNUM = frozenset((string.ascii_letters + string.digits).encode())


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    n = np.zeros(len(x), np.uint8)
    for b in BITS.tolist():
        n[(x >> np.uint64(b)) > 0] = b + 1  # more than b bits: the next width
    return n


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block's first word)."""
    total = len(ids)
    rows = -(-total // BLOCK)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    x = np.zeros(rows * BLOCK + 60, np.uint64)
    x[:total] = ids
    need = np.zeros((rows, BLOCK + 60), np.uint8)  # bits, and nothing after the block
    need[:, :BLOCK] = _bit_lengths(x[: rows * BLOCK]).reshape(rows, BLOCK)
    sel = np.full((rows, BLOCK), ESCAPE, np.uint8)
    most, n = need, 1
    for s in range(len(COUNTS) - 1, -1, -1):
        while n < COUNTS[s]:
            step = min(n, int(COUNTS[s]) - n)
            most = np.maximum(most[:, :-step], most[:, step:])
            n += step
        sel[most[:, :BLOCK] <= BITS[s]] = s
    took = np.append(COUNTS, [1, 1])
    flat = sel.ravel()
    last = np.minimum((np.arange(rows) + 1) * BLOCK, total)
    live, at = np.arange(rows), np.arange(rows) * BLOCK
    row_of, pos_of, round_of, r = [], [], [], 0
    while len(live):  # one word of every block at a time
        row_of.append(live), pos_of.append(at), round_of.append(np.full(len(live), r))
        at = at + took[flat[at]]
        on = at < last[live]
        live, at, r = live[on], at[on], r + 1
    row, pos, order = np.concatenate(row_of), np.concatenate(pos_of), np.concatenate(round_of)
    by = np.lexsort((order, row))
    row, pos = row[by], pos[by]
    s = flat[pos].astype(np.int64)
    width = 1 + (s == ESCAPE)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    end = last[row]
    for k in np.unique(s).tolist():
        w = np.flatnonzero(s == k)
        if k == ESCAPE:
            words[place[w]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[w] + 1] = x[pos[w]]
            continue
        out = np.full(len(w), np.uint64(k) << np.uint64(60), np.uint64)
        for j in range(int(COUNTS[k])):
            inside = pos[w] + j < end[w]
            out |= np.where(inside, x[pos[w] + j], np.uint64(0)) << np.uint64(j * BITS[k])
        words[place[w]] = out
    first = np.searchsorted(row, np.arange(rows))
    return words, place[first].astype(np.uint64)


def decode(words: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """The ids of ``encode``, all blocks at once."""
    if not total:
        return np.zeros(0, np.uint64)
    s = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    # an escape is followed by a raw word, whose top bits mean nothing
    esc = np.flatnonzero(s == ESCAPE)
    if len(esc):
        raw, was = np.zeros(len(words), bool), -2
        for e in esc.tolist():
            if e - 1 == was:
                continue  # itself raw
            raw[e + 1], was = True, e
        head = ~raw
    at = np.flatnonzero(head)
    s = s[at]
    block = np.searchsorted(offsets, at.astype(np.uint64), side="right") - 1
    n = np.append(COUNTS, [1, 1])[s]
    done = np.cumsum(n) - n
    first = np.searchsorted(block, np.arange(len(offsets)))
    pos = block * BLOCK + done - done[first][block]
    end = np.minimum((block + 1) * BLOCK, total)
    out = np.zeros(total + 60, np.uint64)
    for k in np.unique(s).tolist():
        w = np.flatnonzero(s == k)
        if k == ESCAPE:
            out[pos[w]] = words[at[w] + 1]
            continue
        low = np.uint64((1 << int(BITS[k])) - 1)
        payload = words[at[w]] & _PAYLOAD
        for j in range(int(COUNTS[k])):
            ok = np.flatnonzero(pos[w] + j < end[w])
            if not len(ok):
                break
            out[pos[w][ok] + j] = (payload[ok] >> np.uint64(j * BITS[k])) & low
    return out[:total]


def pack_section(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets = encode(ids)
    head = np.array([len(doc_ids), len(ids), len(offsets), len(words)], np.uint64)
    parts = [np.array([i or 0 for i in doc_ids], np.int64), np.array([i is None for i in doc_ids], np.uint8), np.array(lengths, np.uint64), offsets, words]
    return b"S8B1" + head.tobytes() + b"".join(p.tobytes() for p in parts)


def read_section(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, null flags, lengths, ids) of a section."""
    if raw[:4] != b"S8B1":
        raise ValueError("not a Simple-8b section")
    docs, total, rows, n = np.frombuffer(raw, np.uint64, 4, 4).astype(int).tolist()
    at, out = 36, []
    for dtype, count in ((np.int64, docs), (np.uint8, docs), (np.uint64, docs), (np.uint64, rows), (np.uint64, n)):
        out.append(np.frombuffer(raw, dtype, count, at))
        at += count * np.dtype(dtype).itemsize
    return out[0], out[1].astype(bool), out[2].astype(np.int64), decode(out[4], out[3], total)


class WordTokenizer:
    """Ids of texts by the tokenizers library, words encoded once.

    White space always parts tokens of this vocabulary and is dropped, and
    letters are lower-cased, so the ids of a text are those of its lower-case
    pieces between ASCII white space; a run of punctuation after a letter or
    digit is a token run of its own. Words of many texts are found, hashed
    (64 bits, and the length) and looked up as arrays; new ones go to the
    library some hundred at a time, parted by a character that is a token by
    itself. Texts with "<|", which may hold special tokens, or with words of
    over LONGEST bytes go to the library whole. At most CACHED_WORDS words
    are kept, some 30 bytes each."""

    PART = b"\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.part = self._ids(self.PART)[-1:]
        if self._ids(b"a \x01 \x01 b")[1:3] != self.part * 2:
            raise ValueError("this vocabulary doesn't part words at white space")
        self._forget()
        self._powers(1 << 16)

    def _forget(self) -> None:
        #: Ascending hashes of known words; where their ids begin, how many; all ids.
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _powers(self, n: int) -> None:
        with np.errstate(over="ignore"):
            base = 0x9E3779B97F4A7C15
            up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)

    @classmethod
    def of_worker(cls, path: str) -> WordTokenizer:
        """One for each Python worker process, whatever tasks it runs."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_sylvan_words", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _ids(self, text: bytes) -> list[int]:
        return self.model.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0].astype("<u4").tobytes()

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each."""
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        start, stop, low = _words(raw)
        whole = np.array([b"<|" in t for t in texts], bool)
        text = np.searchsorted(ends, start, side="right")
        whole[text[stop - start > LONGEST]] = True
        if whole.any():
            use = ~whole[text]
            start, stop, text = start[use], stop[use], text[use]
        where = self._find(low, start, stop)
        n = self.count[where]
        done = np.cumsum(n)
        total = int(done[-1]) if len(done) else 0
        ids = self.flat[np.repeat(self.begin[where] - (done - n), n) + np.arange(total)]
        lengths = np.bincount(text, n, len(texts)).astype(np.int64)
        if whole.any():
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i in np.flatnonzero(whole).tolist():
                parts[i] = np.array(self._ids(texts[i]), np.uint32)
                lengths[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, lengths

    def _hash(self, low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            if len(low) >= len(self.up):
                self._powers(2 * len(low))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * self.up[: len(low)], dtype=np.uint64)])
            return mix64(((total[stop] - total[start]) * self.down[start]) ^ (stop - start).astype(np.uint64))

    def _find(self, low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Places of the words among the known, new ones learnt first."""
        h = self._hash(low, start, stop)
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        at, ok = self._seek(uniq)
        if not ok.all():
            data = low.tobytes()
            fresh = first[~ok]
            self._learn([data[a:b] for a, b in zip(start[fresh].tolist(), stop[fresh].tolist())], uniq[~ok])
            at, ok = self._seek(uniq)
            if not ok.all():  # the store was full and began anew
                return self._find(low, start, stop)
        return at[inv]

    def _seek(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == keys[ok]
        return at, ok

    def _keep(self, keys: np.ndarray, found: list[bytes]) -> None:
        """Add words by their hashes, with their ids as bytes."""
        n = np.array([len(x) // 4 for x in found], np.int64)
        begin = np.cumsum(n) - n + len(self.flat)
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), np.uint32)])
        keys, begin, n = np.concatenate([self.keys, keys]), np.concatenate([self.begin, begin]), np.concatenate([self.count, n])
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.count = keys[order], begin[order], n[order]

    def _learn(self, words: list[bytes], keys: np.ndarray) -> None:
        """Words that end in punctuation are put together from two pieces."""
        if len(self.keys) + 2 * len(words) > CACHED_WORDS and len(self.keys):
            self._forget()
            return
        ends, pieces = [], set()
        for w in words:
            core = w.rstrip(_PUNCTUATION)
            if len(core) < len(w) and core and (core[-1] in _ALNUM or (core[-2:-1] == b"\xc3" and core[-1] not in (0x97, 0xB7))):
                tail = w[len(core) :]
                ends.append((core, tail))
                pieces.add(core)
                pieces.add(tail)
            else:
                ends.append(None)
                pieces.add(w)
        todo = list(pieces)
        raw = np.frombuffer(b" ".join([*todo, b""]), np.uint8)
        stop = np.cumsum([len(w) + 1 for w in todo]) - 1
        h = self._hash(raw, stop - np.array([len(w) for w in todo]), stop)
        at, ok = self._seek(h)
        got: dict[bytes, bytes] = {}
        for w, i in zip([w for w, o in zip(todo, ok.tolist()) if o], at[ok].tolist()):
            got[w] = self.flat[self.begin[i] : self.begin[i] + self.count[i]].tobytes()
        new = [w for w, o in zip(todo, ok.tolist()) if not o]
        plain = [w for w in new if self.PART not in w]
        for i in range(0, len(plain), 512):
            self._batch(plain[i : i + 512], got)
        for w in new:
            if w not in got:
                got[w] = np.array(self._ids(w), np.uint32).tobytes()
        own = [got[w] if e is None else got[e[0]] + got[e[1]] for w, e in zip(words, ends)]
        extra = {int(k): got[w] for w, k, o in zip(todo, h.tolist(), ok.tolist()) if not o}
        for k in keys.tolist():
            extra.pop(int(k), None)
        self._keep(np.concatenate([keys, np.array(list(extra), np.uint64)]), [*own, *extra.values()])

    def _batch(self, words: list[bytes], got: dict[bytes, bytes]) -> None:
        ids = np.array(self._ids((b" " + self.PART + b" ").join(words)), np.uint32)
        cut = np.flatnonzero(ids == self.part[0])
        raw, at = ids.tobytes(), 0
        for w, end in zip(words, [*(4 * cut).tolist(), len(raw)]):
            got[w] = raw[at:end]
            at = end + 4


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and stop (the last byte is a space), and the bytes
    with A-Z lower-cased."""
    inside = np.concatenate([[False], ~_IS_SPACE[raw]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2], _LOWER[raw]


def write_tokens(spark: SparkSession, df: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the sections of ``df`` in ascending document order to ``path``
    (a new folder ``tokens-...`` in the shared one if none is given) and
    return the table of them; the files stay.

    Documents are range-partitioned by id, and rows of one id by a hash of
    the text, so that an id with very many rows is dealt over partitions too;
    that hash, then the text, orders them. Null ids come first. A null text
    is empty and has the end id alone. An empty table gives no rows.
    """
    ready_python(spark, 8)

    def run(batches):
        words = WordTokenizer.of_worker(tokenizer)
        part, seq, within = TaskContext.get().partitionId(), 0, 0
        ids, lengths, parts, n = [], [], [], 0

        def flush():
            section = pack_section(ids, lengths, np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([within], pa.int64()), pa.array([n], pa.int64()), pa.array([section], pa.binary())], ["part", "seq", "within", "n_ids", "section"])

        def groups():
            """Some documents at a time, about 2 MB."""
            at, texts, size = [], [], 0
            for batch in batches:
                for i, t in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary())):
                    t = t.as_py() or b""
                    at.append(i), texts.append(t)
                    size += len(t)
                    if size >= GROUP_BYTES:
                        yield at, texts
                        at, texts, size = [], [], 0
            if at:
                yield at, texts

        for at, texts in groups():
            found, sizes = words.encode_all(texts)
            found, sizes = np.insert(found, np.cumsum(sizes), end_id), sizes + 1
            a = 0
            for i, m in zip(at, sizes.tolist()):
                ids.append(i), lengths.append(m), parts.append(found[a : a + m])
                a, n = a + m, n + m
                if n >= SECTION_IDS:
                    yield flush()
                    seq, within, ids, lengths, parts, n = seq + 1, within + n, [], [], [], 0
        if ids:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"), F.col(text_col).cast("string").alias("text"))
    path = path or f"{shared_dir(spark)}/sylvan/tokens-{uuid.uuid4().hex}"
    docs.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h", "text").mapInArrow(lean(run), SECTIONS).write.option("compression", "uncompressed").parquet(path)
    return spark.read.schema(SECTIONS).parquet(path)


def read_tokens(spark: SparkSession, sections: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in a token table.
    Sums of ids by part (a row for each task that wrote, in one task, then
    broadcast) give the starts; sections are read where they lie."""
    ready_python(spark)
    parts = sections.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(parts.select("part", before.alias("base")))

    def run(batches):
        for batch in batches:
            for start, raw in zip(batch["start"].to_pylist(), batch["section"]):
                docs, null, lengths, ids = read_section(raw.as_py())
                view, ends = ids.astype("<u4"), np.cumsum(lengths)
                crc = [zlib.crc32(view[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=null), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return sections.select("part", "within", "section").join(starts, "part").select((F.col("base") + F.col("within")).alias("start"), "section").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(spark: SparkSession, df: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``df`` (see ``write_tokens`` for nulls, ties
    and where they lie) and read them back: a row per document."""
    return read_tokens(spark, write_tokens(spark, df, tokenizer, path, end_id, id_col, text_col))

"""Operator 3 - BPE encoding and decoding of whole texts with a public tokenizer file.

Every text is encoded by tree concatenation: it is halved down to leaves wherever the halves fall, also inside words; the
leaves are encoded; and neighbours are joined by encoding a window around the join anew, growing it on each side until its
outermost part is encoded as that side already has it. No rule of the tokenizer reaches over white space, so the parts that
a join compares are the chunks between white space, each with its tokens; frequent chunks are remembered.

Unsplit text (a chunk of thousands of letters) has a tree of its own inside, whose joins compare tokens: a BPE encoding is
fixed by its pairs of neighbouring tokens, so agreement at both ends makes the joined encoding exact.

Texts above ``LONG`` characters are cut into rows of leaves, which any executor encodes; the leaves of a text meet again
in one task, as the text did in its row, and are joined by the same tree.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, n_partitions, short_batches, tidy

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters of a text that stays in one row; bytes of a leaf of a text, and of a leaf that is a row of its own; characters of a leaf of unsplit text, and of a chunk that is taken as unsplit; tokens, or chunks, of a first window's side; remembered chunks.
LONG, PART, RUN, LEAF, UNSPLIT, WINDOW, REMEMBERED = 1 << 16, 1024, 1 << 14, 1024, 2048, 1, 250_000
#: Stands for an unsplit chunk among chunks; no chunk is a space.
PLACE = b" "
SPACE = b" \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CHUNKS, INNER, LAST, SPECIAL = range(4)
#: A chunk's ids as little-endian 32-bit integers, and its decoded text.
Code = tuple[bytes, str]
#: Chunks of a piece of text, in order, and their codes.
Node = tuple[list[bytes], list[Code]]


class Bpe:
    """A tokenizer from its JSON: exact encodings of texts of any length, without added, cut or padded tokens."""

    def __init__(self, text: str, part: int = PART, leaf: int = LEAF, unsplit: int = UNSPLIT, window: int = WINDOW):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        self.tok = Tokenizer.from_str(text)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.part, self.leaf, self.unsplit, self.window = part, leaf, unsplit, window
        self.unsplit_at = re.compile(rb"[^\x20\x09-\x0d]{%d,}" % (unsplit + 1))
        self.joins = self.grown = 0
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        spec["model"]["end_of_word_suffix"] = None
        self.inner = Tokenizer.from_str(json.dumps(spec)).model
        self.model = self.tok.model
        added = self.tok.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.special = {t.content: i for i, t in added.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        size = self.tok.get_vocab_size()
        self.names = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.joined = self.tok.decoder is None
        self.new: dict[bytes, Code] = {}
        self.old: dict[bytes, Code] = {}

    # -- unsplit text -------------------------------------------------------------------------------------------

    def leaf_ids(self, piece: str, last: bool) -> list[int]:
        return [t.id for t in (self.model if last else self.inner).tokenize(piece)]

    def _value(self, i: int) -> str:
        name = self.names[i]
        return name.removesuffix(self.suffix) if self.suffix else name

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of two neighbouring pieces' text from their encodings; ``last``: the right one ends its word."""
        if not left or not right:
            return left + right
        i = j = self.window
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            text = "".join(map(self._value, left[len(left) - i :])) + "".join(map(self._value, right[:j]))
            mid = self.leaf_ids(text, last and j == len(right))
            ok_left = i == len(left) or mid[0] == left[len(left) - i]
            ok_right = j == len(right) or mid[-1] == right[j - 1]
            if ok_left and ok_right:
                return left[: len(left) - i] + mid + right[j:]
            i, j = i if ok_left else 2 * i, j if ok_right else 2 * j

    def join_tree(self, parts: list[list[int]]) -> list[int]:
        """Join the leaves of one word, neighbours first; the last part ends the word."""
        while len(parts) > 1:
            n = len(parts)
            parts = [self.join(parts[k], parts[k + 1], k + 2 >= n) if k + 1 < n else parts[k] for k in range(0, n, 2)]
        return parts[0] if parts else []

    def halves(self, piece: str) -> list[str]:
        """Leaves of a word: halves of halves until all are short."""
        n = 1
        while -(-len(piece) // n) > self.leaf:
            n *= 2
        at = [len(piece) * k // n for k in range(n + 1)]
        return [piece[a:b] for a, b in zip(at, at[1:], strict=False)]

    def leaves(self, chunk: str) -> Iterator[tuple[int, str]]:
        """Leaves (kind, text) of a long chunk: special tokens, and words cut into inner and last leaves."""
        for part in self.split_special.split(chunk) if self.split_special else [chunk]:
            if part in self.special:
                yield SPECIAL, part
            elif part:
                text = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                words = self.tok.pre_tokenizer.pre_tokenize_str(text) if self.tok.pre_tokenizer else [(text, None)]
                for word, _ in words:
                    *inner, last = self.halves(word)
                    yield from ((INNER, x) for x in inner)
                    yield LAST, last

    def assemble(self, parts: Iterable[tuple[int, list[int]]]) -> list[int]:
        """Ids of an unsplit chunk from its (kind, ids) leaves in order."""
        out: list[int] = []
        word: list[list[int]] = []
        for kind, ids in parts:
            if kind == SPECIAL:
                out += ids
                continue
            word.append(ids)
            if kind == LAST:
                out += self.join_tree(word)
                word = []
        return out

    def leaf_of(self, kind: int, text: str) -> list[int]:
        return [self.special[text]] if kind == SPECIAL else self.leaf_ids(text, kind == LAST)

    def code(self, ids: list[int]) -> Code:
        return pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids]) if self.joined else ""

    def long_chunk(self, chunk: bytes) -> Code:
        return self.code(self.assemble((k, self.leaf_of(k, x)) for k, x in self.leaves(chunk.decode())))

    # -- texts --------------------------------------------------------------------------------------------------

    def codes(self, chunks: list[bytes]) -> list[Code]:
        """Codes of chunks: remembered ones, unsplit ones by their own tree, the others by the library."""
        new, old = self.new, self.old
        need = {c for c in chunks if c not in new}
        if need:
            if len(new) > REMEMBERED:
                # Chunks not met since the last change are forgotten; those asked for here are looked up or encoded again.
                self.old = old = new
                self.new = new = {}
                need = set(chunks)
            short = []
            for c in need:
                if (known := old.get(c)) is not None:
                    new[c] = known
                elif len(c) > self.unsplit:
                    new[c] = self.long_chunk(c)
                else:
                    short.append(c)
            for c, e in zip(short, self.tok.encode_batch_fast([c.decode() for c in short], add_special_tokens=False) if short else (), strict=True):
                new[c] = self.code(e.ids)
        return list(map(new.__getitem__, chunks))

    def cut(self, text: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
        """Halves of halves of a text, of ``size`` bytes at most, and whether a half's last chunk goes on in the next.

        Unsplit chunks are leaves of their own here, and no character is cut.
        """

        def halves(a: int, b: int) -> Iterator[tuple[int, int]]:
            mid = (a + b) // 2
            while mid > a and text[mid] & 0xC0 == 0x80:
                mid -= 1
            if b - a <= size or mid == a:
                yield a, b
            else:
                yield from halves(a, mid)
                yield from halves(mid, b)

        at = 0
        for m in self.unsplit_at.finditer(text) if len(text) > self.unsplit else ():
            if m.start() > at:
                yield from ((text[a:b], b < m.start() and text[b - 1] not in SPACE and text[b] not in SPACE) for a, b in halves(at, m.start()))
            yield m.group(), False
            at = m.end()
        if at < len(text):
            yield from ((text[a:b], b < len(text) and text[b - 1] not in SPACE and text[b] not in SPACE) for a, b in halves(at, len(text)))

    def join_texts(self, left: Node, right: Node, through: bool) -> Node:
        """The node of two neighbouring pieces of text from theirs; ``through``: a chunk goes on from left to right."""
        if not left[0] or not right[0]:
            return (left[0] + right[0], left[1] + right[1])
        self.joins += 1
        i = j = self.window
        while True:
            i, j = min(i, len(left[0])), min(j, len(right[0]))
            window = b" ".join(left[0][-i:]) + (b"" if through else b" ") + b" ".join(right[0][:j])
            mid = window.split()
            codes = self.codes(mid)
            ok_left = i == len(left[0]) or (mid[0] == left[0][-i] and codes[0] == left[1][-i])
            ok_right = j == len(right[0]) or (mid[-1] == right[0][j - 1] and codes[-1] == right[1][j - 1])
            if ok_left and ok_right:
                return (left[0][:-i] + mid + right[0][j:], left[1][:-i] + codes + right[1][j:])
            self.grown += 1
            i, j = i if ok_left else 2 * i, j if ok_right else 2 * j

    def tree(self, nodes: list[Node], through: list[bool]) -> Node:
        """Neighbours joined, first pairs, then pairs of pairs; ``through``: of each node, whether its last chunk goes on."""
        while len(nodes) > 1:
            n = len(nodes)
            nodes = [self.join_texts(nodes[k], nodes[k + 1], through[k]) if k + 1 < n else nodes[k] for k in range(0, n, 2)]
            through = [through[min(k + 1, n - 1)] for k in range(0, n, 2)]
        return nodes[0] if nodes else ([], [])

    def tree_of(self, nodes: list[Node], through: list[bool]) -> list[Code]:
        """Codes of a text from its pieces; unsplit chunks (nodes of one code, known by their placeholder) stand between trees."""
        out, part, on = [], [], []
        for node, goes_on in zip(nodes, through, strict=True):
            if node[0] == [PLACE]:
                out += self.tree(part, on)[1] + node[1]
                part, on = [], []
            else:
                part.append(node)
                on.append(goes_on)
        return out + self.tree(part, on)[1]

    def node(self, text: bytes) -> Node:
        """A text's chunks and codes by tree concatenation."""
        if len(text) <= self.part and len(text) <= self.unsplit:
            chunks = text.split()
            return chunks, self.codes(chunks)
        pieces = list(self.cut(text, self.part))
        split = [x.split() for x, _ in pieces]
        codes, at, nodes = self.codes([c for chunks in split for c in chunks]), 0, []
        for chunks in split:
            nodes.append((chunks, codes[at : at + len(chunks)]))
            at += len(chunks)
        return self.tree(nodes, [t for _, t in pieces])

    def whole(self, codes: list[Code]) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        ids = b"".join([c[0] for c in codes])
        return ids, " ".join([c[1] for c in codes if c[0]]) if self.joined else self.decode(ids)

    def encode(self, text: bytes) -> bytes:
        return self.whole(self.node(text)[1])[0]

    def decode(self, ids: bytes) -> str:
        """As the library's decode with special tokens kept: names joined by spaces where the file has no decoder."""
        some = np.frombuffer(ids, "<u4").tolist()
        return " ".join(map(self.names.__getitem__, some)) if self.joined else self.tok.decode(some, skip_special_tokens=False)


_BUILT: dict[tuple, Bpe] = {}


def forget() -> None:
    """What a task remembers goes with it, and the tokenizer as well: a worker keeps no more memory than before."""
    _BUILT.clear()


def built(spec: str, **knobs) -> Bpe:
    """The worker's tokenizer, built once."""
    key = (hash(spec), *sorted(knobs.items()))
    if key not in _BUILT:
        _BUILT[key] = Bpe(spec, **knobs)
    return _BUILT[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str | None = None, texts: bool = False, long: int = LONG, run: int = RUN, **knobs) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``texts`` also ids and decoded.

    A null text is empty: no tokens, digests of nothing. Repeated rows and null ids stay; an empty table gives an empty
    result; other columns play no part. ``long``, ``run`` and ``knobs`` (part, leaf, unsplit and window of :class:`Bpe`)
    say where texts are cut and joined; no result depends on them.
    """
    spark = docs.sparkSession
    short_batches(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = SCHEMA + (", ids array<int>, decoded string" if texts else "")
    lean = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def row(bpe: Bpe, doc_id: int | None, codes: list[Code]) -> tuple:
        ids, decoded = bpe.whole(codes)
        out = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        return (*out, np.frombuffer(ids, "<u4").astype(np.int32).tolist(), decoded) if texts else out

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        n = 6 if texts else 4
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(n)], names=names[:n])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = built(spec.value, **knobs)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                text = some.column("text").cast(pa.large_binary())
                yield frame([row(bpe, k.as_py(), bpe.node(t.as_py())[1]) for k, t in zip(some.column("doc_id"), text, strict=True)])
        forget()

    short = lean.where(F.length("text") <= long).mapInArrow(tidy(whole), schema)

    names = ["uid", "doc_id", "no", "kind", "word", "through", "data", "ids", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    leaf = "uid long, doc_id long, no long, kind int, word long, through boolean, data binary, ids binary, counts binary"

    def leaf_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Long texts -> their leaves; those of an unsplit chunk share the number of its word."""
        bpe = built(spec.value, **knobs)

        def leaves(text: bytes) -> Iterator[tuple[int, int | None, bool, bytes]]:
            for no, (piece, through) in enumerate(bpe.cut(text, run)):
                if len(piece) > bpe.unsplit and len(piece.split()) == 1 and piece.split()[0] == piece:
                    yield from ((kind, no, False, x.encode()) for kind, x in bpe.leaves(piece.decode()))
                else:
                    yield CHUNKS, None, through, piece

        for b in batches:
            for uid, k, t in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
                some = []
                for no, (kind, word, through, x) in enumerate(leaves(t.as_py())):
                    some.append((uid, k, no, kind, word, through, x, None, None))
                    if len(some) >= 512:
                        yield leaf_batch(some)
                        some = []
                yield leaf_batch(some)
        forget()

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = built(spec.value, **knobs)
        for b in batches:
            out = []
            for uid, k, no, kind, word, through, data, _, _ in zip(*[b.column(c).to_pylist() for c in names], strict=True):
                if kind == CHUNKS:
                    codes = bpe.node(data)[1]
                    ids, counts = b"".join([c[0] for c in codes]), np.array([len(c[0]) // 4 for c in codes], "<u4").tobytes()
                else:
                    data, ids, counts = None, np.array(bpe.leaf_of(kind, data.decode()), "<u4").tobytes(), None
                out.append((uid, k, no, kind, word, through, data, ids, counts))
            yield leaf_batch(out)
        forget()

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        bpe, pdf = built(spec.value, **knobs), pdf.sort_values("no")
        nodes, through, word, inside = [], [], None, []

        def close() -> None:
            if inside:
                nodes.append(([PLACE], [bpe.code(bpe.assemble(inside))]))
                through.append(False)
                inside.clear()

        for kind, own, goes_on, data, ids, counts in zip(*[pdf[c].tolist() for c in ("kind", "word", "through", "data", "ids", "counts")], strict=True):
            some = np.frombuffer(ids, "<u4").tolist()
            if kind != CHUNKS:
                if own != word:
                    close()
                word = own
                inside.append((kind, some))
                continue
            close()
            ends = np.cumsum(np.frombuffer(counts, "<u4")).tolist()
            nodes.append((data.split(), [bpe.code(some[a:z]) for a, z in zip([0, *ends], ends, strict=False)]))
            through.append(goes_on)
        close()
        codes = bpe.tree_of(nodes, through)
        first = pdf["doc_id"].iloc[0]
        return frame([row(bpe, None if pd.isna(first) else int(first), codes)]).to_pandas()

    scratch = Scratch(spark, "bpe")
    numbered = lean.where(F.length("text") > long).withColumn("uid", F.monotonically_increasing_id())
    leaves = scratch.table(numbered.mapInArrow(tidy(cut), leaf), "leaves")
    encoded = leaves.repartition(n_partitions(spark), "uid", "no").mapInArrow(tidy(encode_leaves), leaf)
    return short.unionByName(encoded.groupBy("uid").applyInPandas(assemble, schema))

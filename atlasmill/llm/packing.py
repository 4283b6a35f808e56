"""Best-fit packing of token pieces into sequences, by vectors of capacities.

Documents are tokenised where they lie, cut into pieces only where they are longer than a sequence, and the pieces
(a few numbers each) are dealt by hash into groups of about ``group_rows``, each packed by one task: longest first,
into the open sequence that fits under every constraint (tokens, documents, attention cost) and is best by the chosen
measure. The pieces of sequences that a group leaves with room are packed again, in fewer groups, as long as that is less
than half of the round before; so what stays unfilled is a handful of sequences of the last groups.
"""

from __future__ import annotations

import array
import json
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.shared import stored

GROUP_ROWS = 20_000
#: Share of every capacity that a sequence must have left to be packed again.
ROOM = 1 / 32
#: Characters of a text encoded at once.
PIECE = 1 << 20
#: White space for Python that the tokenizer takes for ordinary characters; the mark that ends a piece; a letter whose
#: lower case is two characters. Texts with one of these, or beyond Latin letters, go through the tokenizer itself.
RARE = "\x1c\x1d\x1e\x1f\0\u0130"
LATIN = 0x180


class PieceEncoder:
    """Ids of a tokenizer of lower-cased BPE with word ends: what its ``encode`` gives without special tokens, faster.

    A text of Latin letters is cut into the tokenizer's own pieces (runs of letters, single digits, runs of signs,
    contractions) and a mark is set behind each. With the mark as a byte, the vocabulary is one of byte strings in
    order of their merges, which a byte-rank encoder merges in the same order: the last byte takes the mark first, as
    no id of a merge is smaller. Any other text is encoded by the tokenizer.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = [t["content"] for t in said["added_tokens"]]
        pattern = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(pattern).findall
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>"): i for t, i in self.whole.get_vocab(with_added_tokens=False).items()}
        self.ranked = tiktoken.Encoding("pieces", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        kind = lambda c: 0 if regex.match(r"\s", c) else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3
        self.kinds = np.array([kind(chr(i)) for i in range(LATIN)], np.uint8)

    def _marked(self, text: str) -> str:
        """The pieces of a lower-case Latin text, each with its mark."""
        if "'" in text:
            return "".join([p + "\0" for p in self.parts(text)])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kinds[points]
        ends = (kind == 2) | (kind != np.append(kind[1:], 0))
        ends[-1] = True
        solid = kind != 0
        at = np.cumsum(solid.astype(np.int64) + (ends & solid))
        out = np.zeros(int(at[-1]), np.uint32)
        out[(at - 1 - ends)[solid]] = points[solid]
        return out.tobytes().decode("utf-32-le")

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if any(c in text for c in RARE) or any(s in text for s in self.special) or (not text.isascii() and ord(max(text)) >= LATIN):
            return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        out, at = [], 0
        while at < len(text):
            end = min(at + PIECE, len(text))
            while end < len(text) and not text[end].isspace():  # pieces don't go beyond white space
                end += 1
            if marked := self._marked(text[at:end].lower()):
                out.append(array.array("I", self.ranked(marked)).tobytes())
            at = end
        return b"".join(out)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32 and, with keep_ids, ids) of each piece of a document's ids, which end_id ends.

    ids: little-endian unsigned 32-bit numbers. A null text is empty and has one piece, end_id alone. Null and repeated ids
    are rows like others. A very long text is encoded in parts, and its ids are held at once. An empty table gives an empty
    result. Other columns are not read, so names may clash.
    """

    names = ["piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = PieceEncoder(tokenizer_path), 4 * capacity
        end = array.array("I", [end_id]).tobytes()
        for b in it:
            which, rows = [], []
            for i, text in enumerate(b.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    which.append(i)
                    rows.append((n, at // 4, len(part) // 4, zlib.crc32(part), *[part] * keep_ids))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int32())), *columns], [id_col, *names])

    picked = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(batches, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long{", ids binary" * keep_ids}")


def vector_best_fit(sizes: np.ndarray, capacities: np.ndarray, measure: str = "norm", weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in it) of each item of sizes (items x resources), none over capacities, packed largest first.

    An item goes to the open bin that fits it under every capacity and that leaves the least weighted norm of residual
    shares (``norm``), or whose residual has the largest weighted dot-product with the item (``dot``); to a new one if
    none fits. A bin in which the smallest item has no room is closed.
    """
    share = sizes / capacities
    weights = np.ones(sizes.shape[1]) if weights is None else weights
    order = np.argsort(-share.sum(axis=1), kind="stable")
    least = sizes.min(axis=0, initial=np.inf)
    alone = (sizes + least > capacities).any(axis=1)
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rest = np.zeros((1024, sizes.shape[1]))  # of open bins
    label = np.zeros(1024, np.int64)
    held: list[int] = []
    n_open = 0
    for i in order:
        if alone[i]:
            bins[i] = len(held)
            held.append(1)
            continue
        fits = np.flatnonzero((rest[:n_open] >= sizes[i]).all(axis=1))
        if len(fits):
            left = rest[fits] / capacities
            value = ((left - share[i]) ** 2 * weights).sum(axis=1) if measure == "norm" else -(left * share[i] * weights).sum(axis=1)
            at = int(fits[np.argmin(value)])
        else:
            if n_open == len(rest):
                rest, label = np.concatenate([rest, np.zeros_like(rest)]), np.concatenate([label, np.zeros_like(label)])
            at, n_open = n_open, n_open + 1
            rest[at], label[at] = capacities, len(held)
            held.append(0)
        b = label[at]
        bins[i], places[i] = b, held[b]
        held[b] += 1
        rest[at] -= sizes[i]
        if (rest[at] < least).any():
            n_open -= 1  # the last open bin takes its place
            rest[at], label[at] = rest[n_open], label[n_open]
    return bins, places


def _laid(bins: np.ndarray, places: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The offset of each piece in its bin."""
    order = np.lexsort((places, bins))
    ends = np.cumsum(length[order])
    starts = ends - length[order]
    first = np.flatnonzero(np.r_[True, np.diff(bins[order]) != 0])
    offset = np.empty(len(order), np.int64)
    offset[order] = starts - np.repeat(starts[first], np.diff(np.r_[first, len(order)]))
    return offset


def _packed(dealt: DataFrame, capacities: np.ndarray, measure: str, turn: int) -> DataFrame:
    """dealt (pieces with _group; after the first turn with sequence_id and offset too) packed group by group, with _open.

    A group that doesn't come out in fewer sequences than it came in keeps those. Turns have sequence_ids apart.
    """
    kept = [c for c in dealt.columns if c not in ("_group", "sequence_id", "offset", "_open")]

    def one(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        table = table.take(pa.array(np.lexsort((table.column("piece").to_numpy(), table.column("ids_crc32").to_numpy(), -length))))
        length = table.column("length").to_numpy()
        size = length.astype(float)
        sizes = np.stack([size, np.ones(len(size)), size**2], axis=1)
        if (sizes > capacities).any():
            raise ValueError("a piece is larger than a sequence")
        bins, places = vector_best_fit(sizes, capacities, measure)
        sequence, offset = bins + (turn << 58) + (table.column("_group")[0].as_py() << 32), _laid(bins, places, length)
        if turn:
            before, of = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
            if len(before) <= bins.max() + 1:
                bins, sequence, offset = of, before[of], table.column("offset").to_numpy()
        held = np.stack([np.bincount(bins, weights=x) for x in sizes.T], axis=1)
        open_ = (capacities - held >= ROOM * capacities).all(axis=1)[bins]
        columns = {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()), "_open": pa.array(open_)}
        return pa.table({c: table.column(c) for c in kept} | columns)

    fields = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in kept)
    return dealt.groupBy("_group").applyInArrow(one, f"{fields}, sequence_id long, offset long, _open boolean")


def pack(parts: DataFrame, id_col: str = "doc_id", capacity: int = 2048, max_docs: int | None = None, max_attention: float | None = None, measure: str = "norm", group_rows: int = GROUP_ROWS) -> DataFrame:
    """parts (id_col, piece, start, length, ids_crc32) with sequence_id and offset, the place in it, gapless from 0.

    A sequence holds at most capacity tokens, max_docs pieces and max_attention, the sum of the pieces' squared
    lengths; None sets no limit beyond what capacity implies. A piece that is over a capacity by itself raises.
    Equal pieces and pieces of null ids are packed like any other; ties go by the ids' checksum and the piece's number.
    A very long text is many pieces, dealt like those of other texts. An empty table gives an empty result. Further
    columns are left out.
    """
    capacities = np.array([capacity, max_docs or capacity, max_attention or float(capacity) ** 2], float)
    rest = parts.select(id_col, "piece", "start", "length", "ids_crc32")
    names, key, done, rows = [*rest.columns, "sequence_id", "offset"], [id_col, "piece", "ids_crc32"], [], rest.count()
    for turn in range(32):  # rows are halved each time
        groups = max(1, round(rows / group_rows))
        packed = _packed(rest.withColumn("_group", F.pmod(F.xxhash64(*key), F.lit(groups))), capacities, measure, turn)
        if groups > 1:
            packed = stored(packed, "packed")
            left = packed.where("_open").count()
        if groups == 1 or not 0 < left <= rows / 2:
            done.append(packed)
            break
        done.append(packed.where("not _open"))
        rest, key, rows = packed.where("_open"), ["sequence_id"], left
    return reduce(DataFrame.unionByName, [d.select(*[f"`{c}`" for c in names]) for d in done])

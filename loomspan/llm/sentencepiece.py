"""SentencePiece encoding by batched Viterbi, and decoding.

A model file gives pieces and scores. The distinct words of a few megabytes of text advance together, words of one
length at a time: hashes of all substrings that end at a position probe the sorted
hashes of the pieces, and the best predecessor becomes the position's backpointer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._base import pieces, table
from loomspan.llm._words import LENGTH, Prefix, U, mix, powers

#: Public vocabulary file; any SentencePiece model without a character map can be named instead.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: characters from which on a word is cut where no piece spans
LONG_WORD = 256


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; messages stay bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def _symbols(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U) * U(0x9E3779B97F4A7C15) + U(77))


@dataclass
class Vocabulary:
    """Pieces of a model, in arrays. The pieces that text can match have a rank each: single
    characters first, then the others from the best score to the worst."""

    names: list[bytes]
    #: sorted substring hashes, the rank of each, and a table that rules out most other hashes
    keys: np.ndarray
    key_rank: np.ndarray
    likely: np.ndarray
    #: by rank: id, score, what its last merge joins (itself for a character), length, polynomial
    ids: np.ndarray
    scores: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray
    raw: np.ndarray
    single: np.ndarray
    unknown: int
    unknown_score: float
    byte_ids: np.ndarray | None
    dummy_prefix: bool
    merges: bool
    #: by rank: the pieces' texts, and their ranks
    texts: list[str]
    by_name: dict[str, int]
    #: pairs of ranks that were tried, one in each place, with the answer in the last bit
    tried: np.ndarray = field(default_factory=lambda: np.full(1 << 21, -1, np.int64), repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tried"}

    def __setstate__(self, state):
        self.__dict__.update(state, tried=np.full(1 << 21, -1, np.int64))

    def rank_of(self, key: np.ndarray) -> np.ndarray:
        """The rank of the piece with each hash, -1 where there is none."""
        out = np.full(len(key), -1, np.int32)
        maybe = np.flatnonzero(self.likely[(key & U(len(self.likely) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        good = self.keys[at] == key[maybe]
        out[maybe[good]] = self.key_rank[at[good]]
        return out


def _last_merge(text: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """What the last merge joins when byte-pair merging makes ``text``; None if it doesn't."""
    parts, last = list(text), None
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 30))
        last = (parts[best], parts[best + 1])
        if last[0] + last[1] not in rank:
            return None
        parts[best : best + 2] = ["".join(last)]
    return last


def load(path: str = MODEL) -> Vocabulary:
    with open(path, "rb") as f:
        return parse(f.read())


def parse(model: bytes) -> Vocabulary:
    names, scores, kinds, spec, trainer = [], [], [], {3: 1, 4: 1}, {3: 1}
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            names.append(piece.get(1, b"").decode())
            scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer |= dict(_fields(value))
        elif number == 3:
            spec |= dict(_fields(value))
    if spec.get(2) or spec.get(4):
        raise ValueError("models that map characters or remove white space are not supported")
    if USER in kinds or trainer[3] not in (1, 2):
        raise ValueError("word and character models and user-defined pieces are not supported")
    kinds, s, merges = np.array(kinds), np.array(scores), trainer[3] == 2
    match = [i for i in np.flatnonzero(kinds == NORMAL)]
    if any("▁" in names[i].lstrip("▁") for i in match):
        raise ValueError("a piece goes on into the next word")
    match.sort(key=lambda i: (len(names[i]) > 1, -s[i], i))
    last = {}
    if merges:
        rank = {names[i]: r for r, i in enumerate(match)}
        if {c for i in match for c in names[i]} - rank.keys():
            raise ValueError("a character of a piece is no piece")
        last = {i: _last_merge(names[i], rank) for i in match if len(names[i]) > 1}
        match = [i for i in match if len(names[i]) == 1 or last[i]]  # no merges lead to the others
    rank = {names[i]: r for r, i in enumerate(match)}
    left, right = (np.array([rank[last[i][j]] if last.get(i) else r for r, i in enumerate(match)], np.int32) for j in (0, 1))
    text = np.frombuffer("".join(names[i] for i in match).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(names[i]) for i in match])
    end = np.cumsum(sizes)
    prefix = Prefix(_symbols(text))
    keys = prefix.hashes(end - sizes, end)
    order = np.argsort(keys)
    if (np.diff(keys[order]) == 0).any():
        raise ValueError("two pieces share a hash")
    likely = np.zeros(1 << 21, bool)
    likely[(keys & U(len(likely) - 1)).astype(np.int64)] = True
    byte_ids = None
    if trainer.get(35):
        by_byte = {int(names[i][3:5], 16): i for i in np.flatnonzero(kinds == BYTE)}
        byte_ids = np.array([by_byte[b] for b in range(256)], np.int32)
    return Vocabulary(
        [bytes([int(n[3:5], 16)]) if k == BYTE else n.replace("▁", " ").encode() for n, k in zip(names, kinds)],
        keys[order], order.astype(np.int32), likely, np.array(match, np.int32), s[match], left, right, sizes.astype(np.int64),
        (prefix.acc[end] - prefix.acc[end - sizes]) * prefix.down[end - sizes], np.unique(text),
        int(np.flatnonzero(kinds == UNKNOWN)[0]), float(s[match].min()) - 10.0, byte_ids, bool(spec[3]), merges, [names[i] for i in match], rank,
    )


def _side_by_side(v: Vocabulary, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether byte-pair merging leaves pieces ``one`` and ``two`` next to each other.

    Their merges are undone from the last: as long as a merge across the border would
    have come before the one that is undone, the two don't stay."""
    key = one.astype(np.int64) << 21 | two.astype(np.int64) << 1
    place = (mix(key.view(U)) & U(len(v.tried) - 1)).astype(np.int64)
    kept = v.tried[place]
    out = (kept & 1) == 1
    live = np.flatnonzero(kept >> 1 != key >> 1)
    asked = live
    a, b, bound = one[live], two[live], np.full(len(live), 1 << 30, np.int64)
    up = powers(64)[0]
    out[live] = True
    while len(live):
        size = v.sizes[a] + v.sizes[b]
        joined = v.rank_of(mix(v.raw[a] + v.raw[b] * up[v.sizes[a]] + size.astype(U) * LENGTH))
        stay = ~((joined >= 0) & (joined < bound))
        out[live[~stay]] = False
        live, a, b, bound = live[stay], a[stay], b[stay], bound[stay]
        one_whole, two_whole = v.left[a] == a, v.left[b] == b
        undo_one = ~one_whole & ((a > b) | two_whole)
        undo_two = ~two_whole & ~undo_one
        bound = np.where(undo_one, a, np.where(undo_two, b + 1, bound))
        a, b = np.where(undo_one, v.right[a], a), np.where(undo_two, v.left[b], b)
        more = undo_one | undo_two
        live, a, b, bound = live[more], a[more], b[more], bound[more]
    v.tried[place[asked]] = key[asked] | out[asked]
    return out


def _viterbi(v: Vocabulary, prefix: Prefix, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces of words of one ``length``, from left to right, and how many for each word.

    In a unigram model the best sum of scores leads to each position. In a byte-pair
    model a path's worth is whether all its neighbours stay side by side; exactly one
    path to each position does, and it ends in what merging makes of that prefix."""
    n = len(start)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0.0
    back = np.zeros((n, length + 1), np.int16)
    piece = np.full((n, length + 1), -1, np.int32)
    longest = int(v.sizes.max())
    for end in range(1, length + 1):
        open_ = np.arange(n)
        for size in range(min(end, longest), 0, -1):  # of equal sums the longest last piece counts
            rank = v.rank_of(prefix.hashes(start[open_] + (end - size), start[open_] + end))
            hit = rank >= 0
            if v.merges:
                at, rank = open_[hit], rank[hit]
                if end > size:
                    good = _side_by_side(v, piece[at, end - size], rank)
                    at, rank = at[good], rank[good]
                best[at, end], back[at, end], piece[at, end] = 0.0, size, rank
                if len(at):
                    open_ = open_[piece[open_, end] < 0]
                continue
            score = np.where(hit, v.scores[rank], v.unknown_score if size == 1 else -np.inf)
            total = best[:, end - size] + score
            better = total > best[:, end]
            best[better, end], back[better, end], piece[better, end] = total[better], size, rank[better]
    at, rows, found = np.full(n, length), np.arange(n), []
    if not back[:, 1:].all():
        raise RuntimeError("no path of pieces leads to some position")
    while len(rows):
        found.append((rows, piece[rows, at[rows]]))
        at[rows] -= back[rows, at[rows]]
        rows = rows[at[rows] > 0]
    row, ranks = (np.concatenate([f[i] for f in found[::-1]]) for i in (0, 1))
    order = np.argsort(row, kind="stable")
    return np.where(ranks >= 0, v.ids[ranks], v.unknown)[order].astype(np.int32), np.bincount(row, minlength=n)


def _hits(v: Vocabulary, prefix: Prefix, start: int, stop: int, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size of a piece: where from ``low`` to ``high`` such pieces of the word start:stop end, and their ranks."""
    out = []
    for size in range(1, int(v.sizes.max()) + 1):
        end = np.arange(max(low, start + size), min(high, stop + 1))
        rank = v.rank_of(prefix.hashes(end - size, end))
        out.append((end[rank >= 0], rank[rank >= 0]))
    return out


def _borders(v: Vocabulary, prefix: Prefix, start: np.ndarray, end: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Places in long words that no piece of the model spans: what stands before and after is encoded by itself."""
    out = [np.zeros(0, np.int64)]
    for a, b in zip(*(x[end - start > LONG_WORD] for x in (start, end))):
        spans = np.zeros(b - a + 2, np.int32)  # sums to how many pieces span the place before each character
        for low in range(a + 1, b + 1, step):
            for size, (ends, _) in enumerate(_hits(v, prefix, a, b, low, low + step), 1):
                if size > 1:
                    np.add.at(spans, ends - size + 1 - a, 1)
                    np.add.at(spans, ends - a, -1)
        place = np.flatnonzero(np.cumsum(spans[: b - a]) == 0) + a
        out.append(place[place > a])
    return np.concatenate(out)


def _one_by_one(v: Vocabulary, prefix: Prefix, start: np.ndarray, length: int, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """What ``_viterbi`` gives, for a few long words: all probes of some thousands of positions at once, then a
    walk over the positions that keeps what it learned of pairs of pieces."""
    found, counts, stay = [], np.zeros(len(start), np.int64), {}
    for w, a in enumerate(start):
        piece, back, best = [-1] * (length + 1), [0] * (length + 1), [0.0] + [-np.inf] * length
        for low in range(1, length + 1, step):
            high = min(low + step, length + 1)
            options: list[list] = [[] for _ in range(low, high)]
            for size, (ends, ranks) in reversed(list(enumerate(_hits(v, prefix, a, a + length, a + low, a + high), 1))):
                for end, rank in zip((ends - a - low).tolist(), ranks.tolist()):
                    options[end].append((size, rank))
            for end, some in enumerate(options, low):
                if v.merges:
                    for size, rank in some:
                        pair = piece[end - size], rank
                        if end > size and pair not in stay:
                            stay[pair] = pair[0] >= 0 and _stay(v, *pair)
                        if end == size or stay[pair]:
                            piece[end], back[end] = rank, size
                            break
                    continue
                if not any(size == 1 for size, _ in some):
                    some = [*some, (1, -1)]
                for size, rank in some:
                    total = best[end - size] + (v.scores[rank] if rank >= 0 else v.unknown_score)
                    if total > best[end]:
                        best[end], back[end], piece[end] = total, size, rank
            if len(stay) > 1 << 20:
                stay.clear()
        at, ids = length, []
        while at > 0:
            ids.append(int(v.ids[piece[at]]) if piece[at] >= 0 else v.unknown)
            if not back[at]:
                raise RuntimeError("no path of pieces leads to some position")
            at -= back[at]
        found += ids[::-1]
        counts[w] = len(ids)
    return np.array(found, np.int32), counts


def _stay(v: Vocabulary, a: int, b: int) -> bool:
    """``_side_by_side`` of one pair."""
    bound = 1 << 30
    while True:
        joined = v.by_name.get(v.texts[a] + v.texts[b], -1)
        if 0 <= joined < bound:
            return False
        one_whole, two_whole = v.left[a] == a, v.left[b] == b
        if not one_whole and (a > b or two_whole):
            bound, a = a, int(v.right[a])
        elif not two_whole:
            bound, b = b + 1, int(v.left[b])
        else:
            return True


class Known:
    """Encoded words that a worker has met, up to ``most``: the usual ones need no second look."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.keys = most, np.zeros(0, U)
        self.begin, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.most:
            return
        begin = np.cumsum(count) - count + len(self.pool)
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.pool = all_keys[order], np.concatenate([self.pool, ids])
        self.begin, self.count = np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]


def _gather(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indexes of the slices begin[i] : begin[i] + count[i], one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)


def encode_rows(v: Vocabulary, data: np.ndarray, off: np.ndarray, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts ``data[off[i]:off[i + 1]]`` one after the other, and the ids' row offsets."""
    n = len(off) - 1
    lead = (data & 0xC0) != 0x80
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    cut = np.concatenate([[0], np.cumsum(lead)])[off]
    full = cut[1:] > cut[:-1]
    if v.dummy_prefix:  # a space before each text that has characters
        codes = np.insert(codes, cut[:-1][full], 32)
        cut = cut + np.concatenate([[0], np.cumsum(full)])
    codes = np.where(codes == 32, SPACE, codes).astype(np.uint32)
    begins = np.zeros(len(codes) + 1, bool)
    begins[cut[:-1][full]] = True
    space = codes == SPACE
    begins[:-1] |= space & ~np.concatenate([[False], space[:-1]])
    at = np.minimum(np.searchsorted(v.single, codes), len(v.single) - 1)
    strange = v.single[at] != codes  # in no piece: a word of its own
    begins[:-1] |= strange
    begins[1:] |= strange
    prefix = Prefix(_symbols(codes))
    start = np.flatnonzero(begins[:-1])
    borders = _borders(v, prefix, start, np.append(start[1:], len(codes)).astype(np.int64))
    start = np.union1d(start, borders) if len(borders) else start
    end = np.append(start[1:], len(codes)).astype(np.int64)
    row = np.searchsorted(cut[1:], start, side="right")
    keys, first, which = np.unique(prefix.hashes(start, end), return_index=True, return_inverse=True)
    known = known or Known()
    fresh = np.flatnonzero(known.find(keys) < 0)
    w_start, w_size = start[first[fresh]], (end - start)[first[fresh]]
    odd = strange[w_start]
    parts, owners, counts = [], [], np.zeros(len(fresh), np.int64)
    for size in np.unique(w_size[~odd]):
        group = np.flatnonzero((w_size == size) & ~odd)
        for block in np.array_split(group, max(1, len(group) * int(size) // 2_000_000)):
            if len(block):
                # the batch costs a fixed time a position, the walk one a word and a shorter one a character
                few = size > 32 and len(block) * (60 + size) < 340 * size
                ids, counts[block] = _one_by_one(v, prefix, w_start[block], int(size)) if few else _viterbi(v, prefix, w_start[block], int(size))
                parts.append(ids)
                owners.append(block)
    for i in np.flatnonzero(odd):
        parts.append(np.array([v.unknown], np.int32) if v.byte_ids is None else v.byte_ids[list(chr(codes[w_start[i]]).encode())])
        counts[i] = len(parts[-1])
        owners.append(np.array([i]))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    known.add(keys[fresh[owner]], ids, counts[owner])
    at = known.find(keys)
    begin, size, pool = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.concatenate([known.pool, ids])
    begin[at >= 0], size[at >= 0] = known.begin[at[at >= 0]], known.count[at[at >= 0]]
    own = fresh[owner]
    begin[own], size[own] = len(known.pool) + np.cumsum(counts[owner]) - counts[owner], counts[owner]
    lengths = size[which]
    out = pool[_gather(begin[which], lengths)]
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, weights=lengths, minlength=n).astype(np.int64))])


def decode_rows(vocabulary: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of the texts of id lists, and their row offsets; the space before a text is taken off."""
    sizes = np.array([len(x) for x in vocabulary.names], np.int64)
    text, begin = np.frombuffer(b"".join(vocabulary.names), np.uint8), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    lengths = sizes[ids]
    out = text[_gather(begin[ids], lengths)]
    edge = np.concatenate([[0], np.cumsum(lengths)])[off]
    if vocabulary.dummy_prefix:
        full = edge[1:] > edge[:-1]
        first = edge[:-1][full]
        first = first[out[first] == 32]
        keep = np.ones(len(out), bool)
        keep[first] = False
        out, edge = out[keep], np.concatenate([[0], np.cumsum(keep)])[edge]
    return out.tobytes(), edge


def _encode(vocabulary: Vocabulary, check: bool):
    def run(batches):
        known = Known()
        for batch in batches:
            for part, data, off in pieces(batch, 1, 2_000_000):
                ids, edge = encode_rows(vocabulary, data, off, known)
                columns = [part.column(0), pa.array(np.diff(edge)), pa.ListArray.from_arrays(edge.astype(np.int32), pa.array(ids, pa.int32()))]
                names = ["id", "n_tokens", "token_ids"]
                if check:
                    text, back = decode_rows(vocabulary, ids, edge)
                    raw = data.tobytes()
                    columns.append(pa.array([text[a:b] == raw[c:d] for a, b, c, d in zip(back[:-1], back[1:], off[:-1], off[1:])]))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, check: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, n_tokens, token_ids and, with ``check``, round_trip:
    whether decoding gives the text again.

    For a unigram model, ids are those of the segmentation with the largest sum of piece
    scores (of equal sums, that with the longest last piece at each position); for a
    byte-pair model, those that its merges give. Characters in no piece become byte
    pieces, or the unknown id where the model has no bytes. Null and empty texts have no
    ids. A text that has U+2581 itself decodes to spaces there. The driver reads ``model``. Repeated rows get equal ids; other columns are
    ignored; an empty table gives none.
    """
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(_encode(load(model), check), f"id {kind}, n_tokens long, token_ids array<int>" + ", round_trip boolean" * check)
    return out.withColumnRenamed("id", id_col)


def _decode(vocabulary: Vocabulary):
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lists = lists.fill_null([]) if lists.null_count else lists
            off = np.asarray(lists.offsets, np.int64)
            text, edge = decode_rows(vocabulary, np.asarray(lists.flatten(), np.int64), off - off[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text[a:b].decode(errors="replace") for a, b in zip(edge[:-1], edge[1:])], pa.string())], ["id", "text"])

    return run


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """The id and the text of each id list; a null or empty list gives an empty text, bytes
    that are no UTF-8 give U+FFFD."""
    kind = dict(encoded.dtypes)[id_col]
    out = encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(_decode(load(model)), f"id {kind}, text string")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col))


def op2_sentencepiece(spark, sf_dir):
    """Ids and the check of their decoding for every whole text of ``documents``. Null and empty texts have no ids; repeated
    rows get equal rows."""
    return encode(table(spark, sf_dir, "documents"), check=True)

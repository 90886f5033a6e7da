"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text gets one space in front, spaces become the whitespace marker, and the segmentation with
the largest sum of log scores is taken. Of two that end in the same place with equal sums, the
one with the longer last piece wins. A character that is no piece is spelled in byte pieces, and
so is the marker itself where a text holds it; therefore decoding gives back every text exactly.

No piece of a usable vocabulary has a marker after another character, so the best segmentation
of a text is that of its stretches "spaces, then anything but spaces". Different stretches of a
block are segmented once, all of them together: the trie is walked from every character at
once, and the sums are taken position by position.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .words import blocks, numbered, text_of

MARKER = "▁".encode()
LITERAL = b"\xff"              # stands for a marker that the text itself holds; never in UTF-8
UNKNOWN_PENALTY = 10.0
BLOCK = 2 << 20
TRIES = 100                    # gaps tried for a node of the trie


class DoubleArray:
    """A trie of byte strings: node s goes by byte c to ``base[s] + c`` if ``check`` says s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        nodes, ends = [{}], {}
        for key, value in zip(keys, values):
            at = 0
            for c in key:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                at = nodes[at][c]
            ends[at] = value
        size = 4 * len(nodes) + 1024
        base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.value = np.full(size, -1, np.int64)
        taken = np.zeros(size, bool)
        taken[0] = True
        place, level = {0: 0}, [0]
        free, tail = 256, 256          # no free slot before, none taken from there on
        while level:
            following = []
            # Nodes with many children first: they are the hardest to fit.
            for node in sorted(level, key=lambda n: -len(nodes[n])):
                if not nodes[node]:
                    continue
                codes = np.array(sorted(nodes[node]))
                while taken[free]:
                    free += 1
                first = int(codes[0])
                # The first gap that fits; after some tries, behind all that is taken.
                start = next((x - first for x in range(free, free + TRIES)
                              if not taken[x - first + codes].any()), tail - first)
                base[place[node]] = start
                taken[start + codes] = True
                check[start + codes] = place[node]
                tail = max(tail, start + int(codes[-1]) + 1)
                for c in codes:
                    child = nodes[node][int(c)]
                    place[child] = start + int(c)
                    following.append(child)
                if tail + TRIES + 256 > len(taken):
                    more = len(taken)
                    base = np.append(base, np.zeros(more, np.int64))
                    check = np.append(check, np.full(more, -1))
                    self.value = np.append(self.value, np.full(more, -1))
                    taken = np.append(taken, np.zeros(more, bool))
            level = following
        for node, value in ends.items():
            self.value[place[node]] = value
        # So that base + byte stays inside.
        self.base, self.check = base, np.append(check, np.full(256, -1))


class Pieces:
    """A vocabulary: ids, scores and bytes of its pieces, and their trie."""

    def __init__(self, pieces: list[tuple[bytes, float]], byte_ids: list[int],
                 special: set[int] = frozenset()):
        """``pieces`` by id; ``byte_ids`` the ids of the 256 byte pieces."""
        skip = special | set(byte_ids)
        usable = [i for i in range(len(pieces)) if i not in skip and pieces[i][0]]
        if any(MARKER in pieces[i][0].lstrip(MARKER) for i in usable):
            raise ValueError("a piece holds a marker after another character")
        self.trie = DoubleArray([pieces[i][0] for i in usable], usable)
        self.score = np.array([s for _, s in pieces])
        self.unknown = float(self.score[usable].min()) - UNKNOWN_PENALTY
        self.byte_ids = np.array(byte_ids, np.int64)
        spelled = [b"" if i in special else p.replace(MARKER, b" ") for i, (p, _) in enumerate(pieces)]
        for byte, i in enumerate(byte_ids):
            spelled[i] = bytes([byte])
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    @classmethod
    def from_model(cls, path: str) -> "Pieces":
        """From a sentencepiece file. Scores of a merge list are its ranks: Zipf's law makes
        log probabilities of them."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(len(model))
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        bytes_ = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        raw = [model.get_score(i) for i in ids]
        ranked = all(float(s).is_integer() for s in raw)
        total = math.log(sum(1 / (k + 1) for k in ids))
        pieces = [(model.id_to_piece(i).encode(),
                   -math.log(1 - s) - total if ranked else s) for i, s in zip(ids, raw)]
        return cls(pieces, [bytes_[b] for b in range(256)], special)


def segment(stretches: list[bytes], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The best ids of every stretch, one after the other, and each stretch's bounds in them."""
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    off = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(stretches), np.uint8)
    n = len(raw)
    word = np.repeat(np.arange(len(stretches)), sizes)
    stop = (off + sizes)[word]
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    width = np.diff(np.append(heads, n))
    trie = pieces.trie
    frm, to, value = [], [], []
    alone = np.zeros(n, bool)                    # characters that are pieces themselves
    wide = np.zeros(n, np.int64)
    wide[heads] = width
    at, state, depth = heads, np.zeros(len(heads), np.int64), 0
    while len(at):
        spot = at + depth
        inside = spot < stop[at]
        at, state, spot = at[inside], state[inside], spot[inside]
        nxt = trie.base[state] + raw[spot]
        good = (trie.check[nxt] == state) & (trie.base[state] > 0)
        at, state = at[good], nxt[good]
        depth += 1
        hit = trie.value[state] >= 0
        if hit.any():
            frm.append(at[hit])
            to.append(at[hit] + depth)
            value.append(trie.value[state[hit]])
            alone[at[hit][wide[at[hit]] == depth]] = True
    lost = heads[~alone[heads]]
    frm.append(lost)
    to.append(lost + wide[lost])
    value.append(np.full(len(lost), -1))
    frm, to, value = map(np.concatenate, (frm, to, value))
    gain = np.where(value >= 0, pieces.score[value], pieces.unknown)
    # Sums by position; the start of each stretch has a slot of its own.
    slot_from, slot_to = frm + word[frm], to + word[frm]
    relative = to - off[word[frm]]
    by = np.lexsort((frm, to, relative))
    slot_from, slot_to, relative, gain, value = (
        x[by] for x in (slot_from, slot_to, relative, gain, value))
    best = np.full(n + len(stretches), -np.inf)
    best[off + np.arange(len(stretches))] = 0.0
    back = np.full(n + len(stretches), -1)
    steps = np.flatnonzero(np.append(True, relative[1:] != relative[:-1])) if len(relative) else []
    for a, b in zip(steps, [*steps[1:], len(relative)]):
        total = best[slot_from[a:b]] + gain[a:b]
        first = np.flatnonzero(np.append(True, slot_to[a + 1:b] != slot_to[a:b - 1]))
        most = np.maximum.reduceat(total, first)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, b - a)))
        winners = np.flatnonzero(total == most[group])
        _, kept = np.unique(group[winners], return_index=True)
        edge = a + winners[kept]
        best[slot_to[edge]] = most
        back[slot_to[edge]] = edge
    # Back from every end at once.
    slots, owners = off + sizes + np.arange(len(stretches)), np.arange(len(stretches))
    lists, places = [], []
    live = sizes > 0
    slots, owners = slots[live], owners[live]
    while len(slots):
        edge = back[slots]
        lists.append(edge)
        places.append(owners)
        slots = slot_from[edge]
        on = slots > (off + np.arange(len(stretches)))[owners]
        slots, owners = slots[on], owners[on]
    if not lists:
        return np.zeros(0, np.int64), np.zeros(len(stretches) + 1, np.int64)
    turn = np.concatenate([np.full(len(x), -k) for k, x in enumerate(lists)])
    edges, owners = np.concatenate(lists), np.concatenate(places)
    by = np.lexsort((turn, owners))
    edges, owners = edges[by], owners[by]
    # Unknown characters become their bytes: a literal marker has three, a space has one.
    ids = value[edges]
    begin = slot_from[edges] - owners
    length = slot_to[edges] - slot_from[edges]
    marker = (ids < 0) & (raw[begin] == LITERAL[0])
    at = np.minimum(begin[:, None] + np.arange(len(MARKER)), n - 1)
    space = (ids < 0) & (length == len(MARKER)) & (
        raw[at] == np.frombuffer(MARKER, np.uint8)).all(axis=1)
    many = np.where((ids >= 0) | space, 1, np.where(marker, len(MARKER), length))
    out_at = np.cumsum(many) - many
    out = np.repeat(ids, many)
    inner = np.arange(len(out)) - np.repeat(out_at, many)
    spell = out < 0
    source = np.repeat(begin, many)[spell] + inner[spell]
    is_marker = np.repeat(marker, many)[spell]
    code = np.where(is_marker, np.frombuffer(MARKER, np.uint8)[np.minimum(inner[spell], 2)],
                    np.where(np.repeat(space, many)[spell], ord(" "),
                             raw[np.minimum(source, n - 1)]))
    out[spell] = pieces.byte_ids[code]
    counts = np.bincount(np.repeat(owners, many), minlength=len(stretches))
    return out, np.concatenate([[0], np.cumsum(counts)])


def _stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """"Spaces, then anything but spaces" of all texts (one space put in front), and bounds."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts,
                                         pa.scalar("", texts.type))
    spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", texts.type), spaced)
    for mark in map(chr, (0x10FFFF, 0x10FFFE, *range(0xFDD0, 0xFDF0))):
        if not pc.any(pc.match_substring(texts, mark)).as_py():
            lists = pc.split_pattern(pc.replace_substring_regex(
                spaced, "([^ ]) ", rf"\1{mark} "), mark)
            return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    raise ValueError("a block holds all 34 noncharacters that can mark a border")


def encode(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts and each text's bounds in them; an empty text has none."""
    flat, bounds = _stretches(texts)
    numbers, different = numbered(flat)
    raw = [x.replace(MARKER, LITERAL).replace(b" ", MARKER)
           for x in different.cast(pa.large_binary()).to_pylist()]
    ids, at = segment(raw, pieces)
    sizes = np.diff(at)[numbers]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(at[numbers] - (ends - sizes), sizes) + np.arange(total)
    return ids[source], np.concatenate([[0], ends])[bounds]


def decode(ids: np.ndarray, bounds: np.ndarray, pieces: Pieces) -> list[bytes]:
    """The texts of the ids: their bytes, less the space that encoding put in front."""
    sizes = pieces.sizes[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(pieces.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
    body = pieces.bytes[source].tobytes()
    at = ends[bounds]
    return [body[a:b].removeprefix(b" ") for a, b in zip(at[:-1], at[1:])]


def encoded(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) as ``doc_id, ids, ids_crc32, n_ids``, one row for each.

    Null and empty texts have no ids. Any text is encoded; other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            for first, part in blocks(text_of(batch), BLOCK):
                ids, at = encode(part, pieces)
                ids = ids.astype(np.int32)
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(part)),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
                     pa.array(sums, pa.int64()), pa.array(np.diff(at), pa.int64())],
                    names=["doc_id", "ids", "ids_crc32", "n_ids"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>, ids_crc32 long, n_ids long")


def decoded(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """Rows with ``ids`` with the text they spell as ``text``; no or null ids spell nothing.

    Ids need not come from ``encode``: bytes that are no UTF-8 become replacement characters. A
    column ``text`` there was before is replaced.
    """
    kept = [c for c in rows.columns if c != "text"]
    schema = rows.select(*kept).schema.add("text", "string")

    def run(batches):
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), pa.scalar([], batch.column("ids").type))
            at = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
            texts = [x.decode(errors="replace") for x in decode(ids, at - at[0], pieces)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, "text"])

    return rows.select(*kept).mapInArrow(run, schema)

"""Documents' runs and ops as Arrow columns: detected, applied and read for some documents at once, without an object a run.

A column of runs or ops is a list of structs a document. Entries of all of them are arrays beside the number of their
document; ids are found by sorting, the document order by ranking the walk over the tree of origins as one list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from driftmerge.operators import diffing

_IDS = [(k, pa.int64()) for k in ("clock", "peer", "o_clock", "o_peer")]
RUN = pa.list_(pa.struct([*_IDS, ("text", pa.string()), ("gone", pa.string())]))
OP = pa.list_(pa.struct([("kind", pa.string()), *_IDS, ("text", pa.string()), ("clocks", pa.list_(pa.int64()))]))

#: Documents, and bytes of them, that are worked on at once; a larger document is alone.
AT_ONCE, BYTES = 256, 1 << 20


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that are small enough."""
    if batch.num_rows > 1 and (batch.num_rows > AT_ONCE or batch.nbytes > BYTES):
        half = batch.num_rows // 2
        yield from parts(batch.slice(0, half))
        yield from parts(batch.slice(half))
    elif batch.num_rows:
        yield batch


def _edges(n: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(n, dtype=np.int64)]


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the n of every entry."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _many(column: pa.Array) -> np.ndarray:
    return pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _entries(column: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The document of each entry of a column of lists, and the entries' fields."""
    inner = column.flatten()
    return np.repeat(np.arange(len(column)), _many(column)), {inner.type.field(k).name: f for k, f in enumerate(inner.flatten())}


def _long(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _bytes(column: pa.Array) -> bytes:
    """The bytes of all texts of a column, one after the other; a null text is empty."""
    column = column.fill_null("")
    if not len(column):
        return b""
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(data)[edges[0] : edges[-1]].tobytes() if edges[-1] > edges[0] else b""


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and how many each has."""
    n = pc.utf8_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(_bytes(column).decode().encode("utf-32-le"), np.uint32), n


def _texts(code: np.ndarray, n: np.ndarray) -> pa.Array:
    """Texts of n code points each."""
    size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    edges = _edges(size)[_edges(n)].astype(np.int32)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(edges.tobytes()), pa.py_buffer(code.tobytes().decode("utf-32-le").encode()))


def _flags(column: pa.Array) -> np.ndarray:
    """Which characters are deleted, of all runs."""
    return np.frombuffer(_bytes(column), np.uint8) == ord("1")


def _lists(many: np.ndarray, entries: dict[str, pa.Array], kind: pa.ListType) -> pa.Array:
    inner = pa.StructArray.from_arrays([entries[f.name] for f in kind.value_type], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(_edges(many).astype(np.int32)), inner)


def live(runs: pa.Array) -> list[pa.Array]:
    """Live text, characters and deleted characters of each document."""
    doc, e = _entries(runs)
    code, n = _codes(e["text"])
    gone = _flags(e["gone"])
    of = np.repeat(doc, n)
    raw, dead = np.bincount(of, minlength=len(runs)), np.bincount(of[gone], minlength=len(runs))
    return [_texts(code[~gone], raw - dead), pa.array(raw.astype(np.int64)), pa.array(dead.astype(np.int64))]


def as_ops(runs: pa.Array) -> pa.Array:
    """Runs as the ops that bring them and their deletes to another replica."""
    doc, e = _entries(runs)
    _, n = _codes(e["text"])
    gone = _flags(e["gone"])
    clocks = (np.repeat(_long(e["clock"]), n) + _within(n))[gone]
    dead = np.bincount(np.repeat(np.arange(len(n)), n)[gone], minlength=len(n))
    # Each run, then its deletes, which may be none.
    two = np.repeat(np.arange(len(n)), 2)
    second = np.arange(len(two)) % 2 == 1
    lists = pa.ListArray.from_arrays(pa.array(_edges(np.where(second, dead[two], 0)).astype(np.int32)), pa.array(clocks))
    at = pa.array(two)
    ids = {k: e[k].take(at) for k in ("clock", "peer", "o_clock", "o_peer")}
    kind = pa.array(np.where(second, "del", "ins").astype(object), pa.string())
    text = pc.if_else(pa.array(second), pa.scalar("", pa.string()), e["text"].take(at))
    return _lists(2 * np.bincount(doc, minlength=len(runs)), {"kind": kind, **ids, "text": text, "clocks": lists}, OP)


def _deletes_first(old: str, edits: list[diffing.Place]) -> list[diffing.Place]:
    """The same edits; where no character is kept between some, one delete and then one insertion, which so hangs on the last character that it replaces.

    An insertion before the whole text hangs on nothing, so a delete that follows, and could as well be that of the first characters, is that.
    """
    if len(edits) > 1 and edits[0][0] == 0 and edits[0][2]:
        k = next((k for k, e in enumerate(edits) if not e[2]), 0)
        x, _, _, size = edits[k]
        if k and old[:x] == old[size : x + size]:
            moved = [(a + size, y, 1, n) for a, y, _, n in edits[:k]]
            edits = [(0, 0, 0, size), *moved, *edits[k + 1 :]]
    out: list[diffing.Place] = []
    x = y = -1  # where the last edit ends
    for edit in edits:
        a, b, move, size = edit
        if a != x or b != y:
            out.append(edit)
        else:
            px, py, before, n = out[-1]
            if move == before:
                out[-1] = (px, py, move, n + size)
            elif move:
                out.append(edit)
            elif len(out) > 1 and (out[-2][0] + out[-2][3], out[-2][1], out[-2][2]) == (px, py, 0):
                out[-2:] = [(*out[-2][:3], out[-2][3] + size), (px + size, py, 1, n)]
            else:
                out[-1:] = [(px, py, 0, size), (px + size, py, 1, n)]
        x, y = (a, b + size) if move else (a + size, b)
    return out


def detect(runs: pa.Array, new: pa.Array, peer: int) -> pa.Array:
    """Ops that turn each document's live text into a new one: ids go on from its last clock, deletes mint none."""
    doc, e = _entries(runs)
    code, n = _codes(e["text"])
    alive = ~_flags(e["gone"])
    start = _long(e["clock"])
    clocks, peers = (np.repeat(start, n) + _within(n))[alive], np.repeat(_long(e["peer"]), n)[alive]
    of = np.repeat(doc, n)[alive]
    last = np.zeros(len(runs), np.int64)
    np.maximum.at(last, doc, start + n - 1)
    edges = _edges(np.bincount(of, minlength=len(runs)))
    whole, cuts = code[alive].tobytes().decode("utf-32-le"), edges.tolist()
    found, at, texts = [], [], []
    for k, text in enumerate(new.fill_null("").to_pylist()):
        old = whole[cuts[k] : cuts[k + 1]]
        edits = _deletes_first(old, diffing.places(old, text)) if old != text else []
        found += edits
        at.append(len(edits))
        texts += [text[y : y + size] if move else "" for _, y, move, size in edits]
    x, _, move, size = np.array(found, np.int64).reshape(-1, 4).T
    row, move = np.repeat(np.arange(len(runs)), at), move.astype(bool)
    x = x + edges[row]
    # A delete is cut where the writer changes.
    turns = np.flatnonzero(np.diff(peers)) + 1
    lo, hi = np.searchsorted(turns, x, "right"), np.searchsorted(turns, x + size, "left")
    pieces = np.where(move, 1, 1 + hi - lo)
    op, part = np.repeat(np.arange(len(x)), pieces), _within(pieces)
    inner = turns if len(turns) else np.zeros(1, np.int64)
    a = np.where(part == 0, x[op], inner[np.minimum(lo[op] + part - 1, len(inner) - 1)])
    z = np.where(part == pieces[op] - 1, (x + size)[op], inner[np.minimum(lo[op] + part, len(inner) - 1)])
    ins, row = move[op], row[op]
    many = np.where(ins, size[op], 0)
    before = np.cumsum(many) - many
    first = _edges(np.bincount(row, minlength=len(runs)))[:-1]
    minted = last[row] + 1 + before - np.r_[before, 0][first][row]
    held, by = np.r_[clocks, 0], np.r_[peers, 0]
    end = len(clocks)
    root = ~ins | (a == edges[row])
    above = np.where(root, end, a - 1)
    target = np.where(ins, end, a)
    sizes = np.where(ins, 0, z - a)
    dead = pa.ListArray.from_arrays(pa.array(_edges(sizes).astype(np.int32)), pa.array(held[np.repeat(target, sizes) + _within(sizes)]))
    mine = pa.array(ins)
    entries = {
        "kind": pc.if_else(mine, pa.scalar("ins"), pa.scalar("del")), "clock": pa.array(np.where(ins, minted, held[target])), "peer": pa.array(np.where(ins, peer, by[target])),
        "o_clock": pa.array(held[above], mask=root), "o_peer": pa.array(by[above], mask=root), "text": pa.array(texts, pa.string()).take(pa.array(op)), "clocks": pc.if_else(mine, pa.scalar(None, dead.type), dead),
    }
    return _lists(np.bincount(row, minlength=len(runs)), entries, OP)


class _Chains:
    """Runs (writer, clock, n) as stretches that don't overlap, by rising writer and clock: what an earlier or longer one covers is left out."""

    def __init__(self, writer: np.ndarray, clock: np.ndarray, n: np.ndarray) -> None:
        order = np.lexsort((-n, clock, writer))
        writer, clock, end = writer[order], clock[order], (clock + n)[order]
        # The furthest end of the writer's runs before: a running maximum of ranks, which start anew with each writer.
        rank = np.empty(len(end), np.int64)
        rank[np.argsort(end, kind="stable")] = np.arange(len(end))
        ends = np.sort(end)
        top = np.maximum.accumulate(writer * (len(end) + 1) + rank) if len(end) else rank
        same = np.r_[False, writer[1:] == writer[:-1]][: len(end)]
        covered = np.where(same, ends[np.r_[0, (top - writer * (len(end) + 1))[:-1]][: len(end)]] if len(end) else end, clock)
        start = np.maximum(clock, covered)
        kept = start < end
        #: The run that each is of, and where it starts and ends.
        self.of, self.writer, self.start, self.n = order[kept], writer[kept], start[kept], (end - start)[kept]

    def holding(self, writer: np.ndarray, clock: np.ndarray) -> np.ndarray:
        """The stretch that holds each id, or -1."""
        if not len(self.of) or not len(clock):
            return np.full(len(clock), -1)
        m = len(self.of)
        side = np.repeat([0, 1], [m, len(clock)])
        order = np.lexsort((side, np.r_[self.start, clock], np.r_[self.writer, writer]))
        near = np.maximum.accumulate(np.where(order < m, order, -1))
        out = np.empty(len(clock), np.int64)
        asked = order >= m
        out[order[asked] - m] = near[asked]
        held = np.maximum(out, 0)
        return np.where((out >= 0) & (self.writer[held] == writer) & (clock < self.start[held] + self.n[held]), out, -1)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each distinct row, rising with it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= np.diff(c[order]) != 0
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _walk(parent: np.ndarray, clock: np.ndarray, peer: np.ndarray, docs: int) -> np.ndarray:
    """The nodes in pre-order, siblings by falling (clock, peer). A parent is a node, n + a document, or -1 for none; what no document leads to is left out.

    The walk enters and leaves each node; how far each step is from the end is found by doubling.
    """
    n = len(parent)
    v = n + docs
    after = np.arange(2 * v)
    after[:v] += v  # entered, left at once
    order = np.lexsort((peer, clock, -parent))[::-1]
    order = order[parent[order] >= 0]
    above = parent[order]
    new = np.r_[True, above[1:] != above[:-1]][: len(order)]
    after[above[new]] = order[new]
    last = np.r_[new[1:], True][: len(order)]
    after[v + order[last]] = v + above[last]
    after[v + order[~last]] = order[1:][~last[:-1]]
    roots = np.arange(n, v)
    after[v + roots[:-1]] = roots[1:]
    end = 2 * v - 1
    left = (after != np.arange(2 * v)).astype(np.int64)
    for _ in range(int(2 * v).bit_length()):
        left += left[after]
        after = after[after]
    there = np.flatnonzero(after[:n] == end)
    return there[np.argsort(-left[there], kind="stable")]


def apply(runs: pa.Array, ops: pa.Array) -> list[pa.Array]:
    """The documents after ops, in any order and repeated: runs, inserted, deleted and waiting characters.

    The order is the pre-order walk of the tree of origins with siblings by falling (clock, peer), as of ``sequence.ordered_runs``: runs are cut where another hangs
    on one of their inner characters, those whose origin never came wait, repeated and overlapping ones count once.
    """
    docs = len(runs)
    r_doc, r = _entries(runs)
    o_doc, o = _entries(ops)
    kept = pc.equal(o["kind"], "ins").fill_null(False)
    mine = kept.to_numpy(zero_copy_only=False)
    i = {k: o[k].filter(kept) for k in ("clock", "peer", "o_clock", "o_peer", "text")}
    d_peer, d_clocks = o["peer"].filter(pc.invert(kept)), o["clocks"].filter(pc.invert(kept))
    both = {k: pa.concat_arrays([r[k], i[k]]) for k in i}
    code, n = _codes(both["text"])
    doc, clock, peer = np.r_[r_doc, o_doc[mine]], _long(both["clock"]), _long(both["peer"])
    root, o_clock, o_peer = both["o_clock"].is_null().to_numpy(zero_copy_only=False), _long(both["o_clock"]), _long(both["o_peer"])
    base, m, known = np.cumsum(n) - n, len(doc), len(r_doc)
    targets = np.repeat(np.flatnonzero(~mine), _many(d_clocks))
    t_doc, t_peer, t_clock = o_doc[targets], np.repeat(_long(d_peer), _many(d_clocks)), _long(d_clocks.flatten())
    writers = _numbered(np.r_[doc, doc, t_doc], np.r_[peer, o_peer, t_peer])
    writer, o_writer, t_writer = writers[:m], writers[m : 2 * m], writers[2 * m :]
    chains = _Chains(writer, clock, n)
    of, k = chains.of, len(chains.of)
    whole = chains.start == clock[of]
    # Origins of first characters: of a part, the character before it.
    c_root, c_clock = whole & root[of], np.where(whole, o_clock[of], chains.start - 1)
    c_writer, c_peer = np.where(whole, o_writer[of], chains.writer), np.where(whole, o_peer[of], peer[of])
    h = np.where(c_root, -1, chains.holding(c_writer, c_clock))
    cut = c_clock + 1 - chains.start[np.maximum(h, 0)] if k else h
    inner = (h >= 0) & (cut < chains.n[np.maximum(h, 0)]) if k else np.zeros(0, bool)
    # Nodes: chains, cut behind the characters that others hang on.
    span = int(chains.n.max(initial=0)) + 1
    key = np.unique(np.r_[np.arange(k) * span, h[inner] * span + cut[inner]])
    chain, off = key // span, key % span
    size = np.r_[off[1:], 0] - off
    final = np.r_[chain[1:] != chain[:-1], True][: len(chain)]
    size[final] = (chains.n[chain] - off)[final]
    above = np.arange(len(key)) - 1
    head = off == 0
    held = np.searchsorted(key, h * span + cut) - 1  # of each chain
    above[head] = np.where(c_root, len(key) + doc[of], np.where(h >= 0, held, -1))
    n_clock, n_peer = chains.start[chain] + off, peer[of][chain]
    order = _walk(above, n_clock, n_peer, docs)
    # Deleted characters: where a run is taken whole its flags are, others are found by their ids.
    flags = np.r_[_flags(r["gone"]), np.zeros(int(n[known:].sum()), bool)]
    dead = np.zeros(len(code), bool)
    plain = np.zeros(m, bool)
    plain[of[whole & (chains.n == n[of])]] = True
    taken = np.repeat(plain, n)
    dead[taken] = flags[taken]
    loose = np.flatnonzero(flags & ~taken)
    entry = np.searchsorted(base + n, loose, "right")
    g_writer, g_clock = np.r_[t_writer, writer[entry]], np.r_[t_clock, clock[entry] + loose - base[entry]]
    at = chains.holding(g_writer, g_clock)
    there = at >= 0
    dead[(base[of] - clock[of])[at[there]] + g_clock[there]] = True
    # What comes out, in order.
    chain_, size_ = chain[order], size[order]
    first = (base[of] + chains.start - clock[of])[chain_] + off[order]
    chars = np.repeat(first, size_) + _within(size_)
    out_doc, gone = doc[of][chain_], dead[chars]
    none = head[order] & c_root[chain_]
    up_clock, up_peer = np.where(head[order], c_clock[chain_], n_clock[order] - 1), np.where(head[order], c_peer[chain_], n_peer[order])
    flag = pa.StringArray.from_buffers(len(order), pa.py_buffer(_edges(size_).astype(np.int32).tobytes()), pa.py_buffer((gone.astype(np.uint8) + ord("0")).tobytes()))
    entries = {"clock": pa.array(n_clock[order]), "peer": pa.array(n_peer[order]), "o_clock": pa.array(up_clock, mask=none), "o_peer": pa.array(up_peer, mask=none), "text": _texts(code[chars], size_), "gone": flag}
    out = _lists(np.bincount(out_doc, minlength=docs), entries, RUN)
    count = lambda of, by: np.bincount(of, by, minlength=docs).astype(np.int64)
    inserted = count(out_doc, size_) - count(r_doc, n[:known])
    deleted = count(np.repeat(out_doc, size_)[gone], None) - count(np.repeat(r_doc, n[:known])[flags[: int(n[:known].sum())]], None)
    waiting = np.zeros(docs, np.int64)
    if len(order) < len(key):
        lost = np.setdiff1d(np.arange(len(key)), order)
        sent = _Chains(writer[known:], clock[known:], n[known:])
        w = np.repeat(chains.writer[chain[lost]], size[lost])
        found = sent.holding(w, np.repeat(n_clock[lost], size[lost]) + _within(size[lost])) >= 0
        waiting = count(np.repeat(doc[of][chain[lost]], size[lost])[found], None)
    return [out, pa.array(inserted), pa.array(deleted), pa.array(waiting)]

"""SentencePiece encoding, decoding and sampled segmentations without replacement."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.llm.common import keep_only, text_of
from tallyquill.llm.pieces import SPACE, Grown, Vocabulary, batches_of, n_bytes
from tallyquill.llm.token_counts import PrefixCounts, split_chunks
from tallyquill.shipping import ship

#: Bytes of the ids and lattices of chunks that a Python worker keeps.
MOST_BYTES = 160 << 20
#: Zipf weights of the pieces: a piece of rank r has probability in proportion to 1 / (r + OFFSET).
OFFSET = 10.0
#: Nodes of a path that are held one by one; those behind are one node together until it is popped.
NEAR = 32
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP, _ROUND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def uniform(seed: np.ndarray, rnd: int, at: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1), a function of the row's seed, the round and the place alone."""
    z = seed + np.uint64((rnd + 1) * int(_ROUND) & 0xFFFFFFFFFFFFFFFF) + at.astype(np.uint64) * _STEP
    for shift, mix in zip((30, 27), _MIX, strict=True):
        z = (z ^ (z >> np.uint64(shift))) * mix
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def below(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers of the given locations, each under the condition that it is below its bound."""
    return -np.logaddexp(-bound, -(location + gumbel(u)))


class Lattices:
    """Lattices of distinct chunks, one after another: rows for characters and ends, cells for pieces.

    The cells of a row are the pieces that begin at its character, the shortest first: the share of
    the segmentations from here on that the row's cells up to this one take (``cdf``), the cell's own
    share (``logp``), the piece's length and id. A character outside the vocabulary is a cell too; if
    it has several bytes, its id is minus its code point minus 1.
    """

    def __init__(self, voc: Vocabulary, log_weights: np.ndarray, byte_weight: float, byte_ids: list[int]) -> None:
        self.voc, self.weights, self.byte_weight, self.byte_ids = voc, log_weights.astype(np.float32), byte_weight, byte_ids
        self.base, self.end = Grown(np.int64), Grown(np.int64)  # by chunk: its first and its last row
        self.first, self.count = Grown(np.int64), Grown(np.int16)  # by row: its cells
        self.cdf, self.logp = Grown(np.float32), Grown(np.float32)
        self.length, self.id = Grown(np.int16), Grown(np.int32)

    def parts(self) -> list[Grown]:
        return [x for x in vars(self).values() if isinstance(x, Grown)]

    def add(self, chunks: list[str]) -> None:
        lengths, base, codes, row, size, piece = self.voc.cells_in(chunks)
        rem = np.repeat(base[1:] - 1, lengths + 1) - np.arange(len(codes))
        count = np.bincount(row, minlength=len(codes))
        after = np.cumsum(count)
        first = after - count
        weight = np.where(piece >= 0, self.weights[piece], self.byte_weight * n_bytes(codes[row]))
        beta, share = np.zeros(len(codes)), np.zeros(len(row))
        by_rem = np.argsort(rem.astype(np.uint16) if len(rem) and rem.max() < 65536 else rem, kind="stable")
        cuts = np.searchsorted(rem[by_rem], np.arange(1, int(rem.max(initial=0)) + 2)).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):  # from the ends backwards; sums within a row don't depend on other rows
            rows = by_rem[lo:hi]
            n = count[rows]
            begin = np.cumsum(n) - n
            cells = np.repeat(first[rows] - begin, n) + np.arange(int(n.sum()))
            x = weight[cells] + beta[row[cells] + size[cells]]
            top = np.maximum.reduceat(x, begin)
            e = np.exp(x - np.repeat(top, n))
            total = np.add.reduceat(e, begin)
            beta[rows] = top + np.log(total)
            share[cells] = e / np.repeat(total, n)
        lp = weight + beta[row + size] - beta[row]
        cdf, place = share, np.arange(len(row)) - first[row]
        at = np.flatnonzero(place == 1)
        while len(at):
            cdf[at] += cdf[at - 1]
            at = at + 1
            at = at[at < len(row)]
            at = at[place[at] > 1]
        cdf[after[count > 0] - 1] = 2.0  # above every uniform number
        ids = np.where(piece >= 0, self.voc.ids[piece], np.int32(-1))
        odd = np.flatnonzero(ids < 0)
        code = codes[row[odd]]
        ids[odd] = np.where(code < 128, np.array(self.byte_ids, np.int32)[np.minimum(code, 127)], -1 - code)
        self.first.add(self.cdf.n + after - count)
        self.count.add(count)
        self.base.add(self.end.a[self.end.n - 1] + 1 + base[:-1] if self.end.n else base[:-1])
        self.end.add(self.base.a[self.base.n - len(chunks) : self.base.n] + lengths)
        for part, x in ((self.cdf, cdf), (self.logp, lp), (self.length, size), (self.id, ids)):
            part.add(x)

    def others(self, cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """log of the share that the other cells of their rows take."""
        share = -np.expm1(np.minimum(self.logp.a[cells].astype(np.float64), 0.0))
        near = np.flatnonzero(share < 0.01)  # single precision can't tell the others from 1 - p there
        if len(near):
            at = self.first.a[rows[near], None] + np.arange(self.voc.longest)
            known = np.arange(self.voc.longest) < self.count.a[rows[near], None]
            beside = np.where(known & (at != cells[near, None]), np.exp(self.logp.a[np.minimum(at, self.logp.n - 1)].astype(np.float64)), 0.0)
            share[near] = beside.sum(axis=1)
        with np.errstate(divide="ignore"):
            return np.log(share)


class Sampler:
    """Top-k segmentations of whole texts by A* search over Gumbel-perturbed lattices.

    A search node is a set of segmentations: those that begin with certain pieces, perhaps without
    some next pieces. Its value is the largest perturbed log-probability of its segmentations, whose
    distribution is a Gumbel located at the set's log-probability, which the lattice's backward sums
    give exactly. The best node is popped; its best segmentation is followed to the end of the text,
    drawing each next piece, and at every piece the set of the segmentations not taken becomes a node
    of its own, with a value drawn below the popped one; far down the path, where the sets are small,
    they are one node, which is taken apart if it is popped. So the kth popped node is the kth largest of
    all perturbed segmentations, drawn without replacement. The search stops after k pops; the best
    value left is the threshold for the inclusion scores.
    """

    def __init__(self, lattices: Lattices) -> None:
        self.lat = lattices

    def sample(self, kind: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text its samples: (piece ids, log-probability, perturbed, log inclusion).

        ``kind`` has the places of the texts' chunks among the lattices, ``sizes`` how many each text has.
        """
        if not len(kind) or not k:
            return [[] for _ in sizes]
        lat = self.lat
        base, end, cell_of, cdf, length, logp = (x.a for x in (lat.base, lat.end, lat.first, lat.cdf, lat.length, lat.logp))
        n_texts, first = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(n_texts), sizes)
        lengths = (end - base[: len(end)])[kind]
        ahead = np.cumsum(lengths) - lengths
        shift = ahead - np.repeat(ahead[np.minimum(first[:-1], len(kind) - 1)], sizes) - base[kind]  # from a row to a place in the text
        ends = end[kind]
        full = np.flatnonzero(sizes)

        def dive(rnd: int, docs: np.ndarray, occ: np.ndarray, row: np.ndarray):
            """Follows each text from the row on in the chunk: cells and rows of its pieces, occurrences and how many each has, cuts by text."""
            reps = first[docs + 1] - occ
            starts = np.cumsum(reps) - reps
            occs = np.repeat(occ - starts, reps) + np.arange(int(reps.sum()))
            rows = base[kind[occs]]
            rows[starts] = row
            upto, moved, seed = ends[occs], shift[occs], seeds[doc[occs]]
            live = np.flatnonzero(rows < upto)
            n_pieces = np.zeros(len(occs), np.int64)
            steps = []
            while len(live):
                r = rows[live]
                u = uniform(seed[live], rnd, moved[live] + r)
                cell = cell_of[r]
                later = np.flatnonzero(cdf[cell] <= u)
                while len(later):
                    cell[later] += 1
                    later = later[cdf[cell[later]] <= u[later]]
                steps.append((live, cell))
                r += length[cell]
                rows[live] = r
                n_pieces[live] += 1
                live = live[r < upto[live]]
            offset = np.concatenate([[0], np.cumsum(n_pieces)])
            p_cell = np.empty(offset[-1], np.int64)
            for s, (live, cell) in enumerate(steps):
                p_cell[offset[live] + s] = cell
            return p_cell, occs, offset, offset[np.concatenate([starts, [len(occs)]])]

        def values(d: np.ndarray, cells: np.ndarray, places: np.ndarray, prefix: np.ndarray, bound, rnd: int) -> np.ndarray:
            """Of the nodes of what texts ``d`` didn't take at these pieces."""
            rows = places - shift[occurrence(d, places)]
            return below(prefix + lat.others(cells, rows), bound, uniform(seeds[d], rnd + 1_000_003, places))

        turns = np.cumsum(lengths)  # where occurrences end, in the texts one after another
        starts_at = np.concatenate([[0], turns])[first[:-1]]

        def occurrence(d: np.ndarray, places: np.ndarray) -> np.ndarray:
            """The chunk occurrence in which a place of a text lies."""
            return np.searchsorted(turns, starts_at[d] + places, side="right")

        def apart(d: int, path: dict, top: float) -> int:
            """Takes the node behind the first ``NEAR`` pieces apart; returns which of its parts has its value.

            A part has the largest value of all with the probability of its share, and the other
            values are drawn below it.
            """
            cells = path["cell"][NEAR:]
            prefix = path["prefix"][NEAR] + np.concatenate([[0.0], np.cumsum(logp[cells], dtype=np.float64)[:-1]])
            places = path["place"][NEAR] + np.concatenate([[0], np.cumsum(length[cells], dtype=np.int64)[:-1]])
            who = np.full(len(cells), d)
            share = np.cumsum(np.exp(prefix - prefix[0] + lat.others(cells, places - shift[occurrence(who, places)])))
            u = uniform(seeds[d : d + 1], path["rnd"] + 5_000_003, places[:1])
            t = int((share > u[0] * share[-1]).argmax())
            g = values(who, cells, places, prefix, top, path["rnd"])
            g[t] = top
            path.update(g=np.concatenate([path["g"][:NEAR], g]), prefix=np.concatenate([path["prefix"][:NEAR], prefix]), place=np.concatenate([path["place"][:NEAR], places]), together=False)
            return t

        #: paths[d]: the paths of a text: their pieces' cells and, for the nodes, the places of the pieces, the
        #: log-probabilities before them and the values
        paths: list[list[dict]] = [[] for _ in range(n_texts)]
        out: list[list[tuple[np.ndarray, float, float, float]]] = [[] for _ in range(n_texts)]
        value = gumbel(uniform(seeds, -1, np.zeros(n_texts, np.int64)))
        docs, occ, row = full, first[full], base[kind[first[full]]]
        shared: list[np.ndarray] = [np.empty(0, np.int32)] * len(full)
        before = np.zeros(len(full))  # log-probabilities of the shared pieces
        for rnd in range(k):
            if not len(docs):
                break
            p_cell, occs, offset, cut = dive(rnd, docs, occ, row)
            lp = logp[p_cell].astype(np.float64)
            ids = lat.id.a[p_cell]
            odd = bool((ids < 0).any())
            at = shift[occ] + row
            counts = np.diff(cut)
            some = np.flatnonzero(counts)
            total = before.copy()
            total[some] += np.add.reduceat(lp, cut[some]) if len(some) else 0.0
            there = np.arange(NEAR) < counts[:, None]
            near = np.minimum(cut[:-1, None] + np.arange(NEAR), max(len(p_cell) - 1, 0))
            prefix = before[:, None] + np.cumsum(np.where(there, lp[near], 0.0), axis=1) if len(p_cell) else np.zeros(there.shape)
            prefix = np.concatenate([before[:, None], prefix], axis=1)
            steps = np.cumsum(np.where(there, length[p_cell[near]], 0), axis=1, dtype=np.int64) if len(p_cell) else np.zeros(there.shape, np.int64)
            places = at[:, None] + np.concatenate([np.zeros((len(docs), 1), np.int64), steps], axis=1)
            g = np.full(there.shape, -np.inf)
            i, j = np.nonzero(there)
            g[i, j] = values(docs[i], p_cell[near[i, j]], places[i, j], prefix[i, j], value[docs[i]], rnd)
            # all that shares the first NEAR pieces, but for the path itself, is one node
            far = np.flatnonzero(counts > NEAR)
            with np.errstate(divide="ignore"):
                behind = prefix[far, NEAR] + np.log(-np.expm1(np.minimum(total[far] - prefix[far, NEAR], 0.0)))
            g = np.concatenate([g, np.full((len(docs), 1), -np.inf)], axis=1)
            g[far, NEAR] = below(behind, value[docs[far]], uniform(seeds[docs[far]], rnd + 4_000_003, places[far, NEAR]))
            for i, d in enumerate(docs.tolist()):
                a, b, head, m = int(cut[i]), int(cut[i + 1]), shared[i], min(NEAR + 1, int(counts[i]))
                found = self.spelled(ids[a:b]) if odd else ids[a:b]
                out[d].append((np.concatenate([head, found]) if len(head) else found, float(total[i]), float(value[d]), 0.0))
                paths[d].append({"cell": p_cell[a:b], "place": places[i, :m], "prefix": prefix[i, :m], "g": g[i, :m], "head": head, "rnd": rnd, "together": m > NEAR, "out": {}})
            nxt_docs, nxt_occ, nxt_row, nxt_heads = [], [], [], []
            for d in docs.tolist():
                top, n = max(((float(p["g"].max(initial=-np.inf)), n) for n, p in enumerate(paths[d])), default=(-np.inf, 0))
                if top == -np.inf or rnd == k - 1:  # no segmentation is left, or its value is the threshold
                    out[d].append((np.empty(0, np.int32), 0.0, top, 0.0))
                    continue
                path = paths[d][n]
                t = int(path["g"].argmax())
                if path["together"] and t == NEAR:
                    t += apart(d, path, top)
                cell, place = int(path["cell"][t]), int(path["place"][t])
                o = int(occurrence(np.array([d]), np.array([place]))[0])
                r = place - int(shift[o])
                begin = int(cell_of[r])
                gone = path["out"].setdefault(t, [cell - begin])
                left = np.exp(logp[begin : begin + int(lat.count.a[r])].astype(np.float64))
                left[gone] = 0.0
                u = uniform(seeds[d : d + 1], rnd + 2_000_003, np.array([place]))
                j = int((np.cumsum(left) > u[0] * left.sum()).argmax())
                value[d] = top
                log_before = float(path["prefix"][t])
                gone.append(j)
                left[j] = 0.0
                mass = float(left.sum())
                if mass > 0:
                    u = uniform(seeds[d : d + 1], rnd + 3_000_003, np.array([place]))
                    path["g"][t] = below(np.array([log_before + np.log(mass)]), np.array([top]), u)[0]
                else:
                    path["g"][t] = -np.inf
                nxt_docs.append(d)
                nxt_occ.append(o)
                nxt_row.append(r + int(length[begin + j]))
                nxt_heads.append((np.concatenate([path["head"], self.spelled(lat.id.a[np.append(path["cell"][:t], begin + j)])]), log_before + float(logp[begin + j])))
            docs, occ, row = np.array(nxt_docs, np.int64), np.array(nxt_occ, np.int64), np.array(nxt_row, np.int64)
            shared, before = [x for x, _ in nxt_heads], np.array([x for _, x in nxt_heads])
        found = []
        for samples in out:
            threshold = samples[-1][2] if samples else 0.0
            found.append([(ids, lp, g, log_inclusion(lp, threshold)) for ids, lp, g, _ in samples[:-1]])
        return found

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The ids, with the bytes of the characters for which one id isn't enough."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        parts, last = [], 0
        for i in odd.tolist():
            parts += [ids[last:i], np.array([self.lat.byte_ids[x] for x in chr(-1 - int(ids[i])).encode("utf-8", "surrogatepass")], np.int32)]
            last = i + 1
        return np.concatenate([*parts, ids[last:]]).astype(np.int32)


def log_inclusion(log_p: float, threshold: float) -> float:
    """log of 1 - exp(-exp(log_p - threshold)): how likely a segmentation gets above the threshold."""
    if threshold == -np.inf:
        return 0.0
    x = log_p - threshold
    return float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)


class Codec(PrefixCounts):
    """Encoding by chunks with the library's ids, decoding, and sampling."""

    def __init__(self, path: str | None = None, most_bytes: int | None = None) -> None:
        super().__init__(path)
        self.most_bytes = MOST_BYTES if most_bytes is None else most_bytes
        sp = self.sp
        bytes_at = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        ranks = np.arange(len(self.voc.ids)) + OFFSET
        norm = np.log((1 / ranks).sum())
        self.begins = np.array([sp.id_to_piece(i).startswith(SPACE) for i in range(sp.get_piece_size())])
        self.lat = Lattices(self.voc, -np.log(ranks) - norm, float(-np.log(ranks[-1]) - norm), [bytes_at[b] for b in range(256)])
        self.sampler = Sampler(self.lat)
        self.tokens, self.n_tokens, self.first_token = Grown(np.int32), Grown(np.int64), Grown(np.int64)
        self.place: dict[str, int] = {}
        self.marks = [(x, 0) for x in self.parts()]
        self.place_of([""])

    def parts(self) -> list[Grown]:
        return [*self.lat.parts(), self.tokens, self.n_tokens, self.first_token]

    def add(self, chunks: list[str]) -> None:
        """Ids and lattices of new chunks. Those without a space inside are encoded as one text, in which
        they stay apart, each beginning with a space mark; they come first."""
        single = [c for c in chunks if c and " " not in c]
        ids = np.array(self.sp.encode(" ".join(single)) if single else [], np.int32)
        counts = np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids))) if single else np.empty(0, np.int64)
        if len(counts) != len(single):
            raise ValueError("a chunk's pieces don't begin with a space mark")
        other = [np.array(self.sp.encode(c) if c else [self.sp.piece_to_id(SPACE)], np.int32) for c in chunks[len(single) :]]
        counts = np.concatenate([counts, np.array([len(x) for x in other], np.int64)])
        self.first_token.add(self.tokens.n + np.cumsum(counts) - counts)
        self.n_tokens.add(counts)
        self.tokens.add(np.concatenate([ids, *other]))
        self.lat.add([" " + c for c in chunks])

    def place_of(self, chunks: list[str]) -> np.ndarray:
        """Where the ids and lattices of distinct chunks are, those of new chunks being added.

        A worker keeps them from batch to batch, up to ``most_bytes``; what comes then stays for one batch.
        """
        for part, n in self.marks:
            part.n = n
        found = list(map(self.place.get, chunks))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            plain = [i for i in new if (c := chunks[i]) and " " not in c]
            if len(plain) < len(new):
                new = plain + [i for i in new if not chunks[i] or " " in chunks[i]]
            n = self.lat.base.n
            self.add([chunks[i] for i in new])
            for j, i in enumerate(new, n):
                found[i] = j
            if sum(x.n * x.a.itemsize for x in self.parts()) + 100 * len(self.place) < self.most_bytes:
                self.place.update((chunks[i], found[i]) for i in new)
                self.marks = [(x, x.n) for x in self.parts()]
        return np.array(found, np.int64)

    def encode(self, text: str) -> list[int]:
        at = {c: i for c, i in zip(kinds, self.place_of(kinds).tolist(), strict=True)} if (kinds := list(set(self.chunks(text)))) else {}
        return [x for c in self.chunks(text) for x in self.tokens.a[self.first_token.a[at[c]] :][: self.n_tokens.a[at[c]]].tolist()]

    def decode(self, ids) -> str:
        """The text whose segmentation this is; the space that the encoder puts in front goes."""
        out: list[bytes] = []
        sp = self.sp
        for i in map(int, ids):
            out.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode())
        return b"".join(out).decode("utf-8", "surrogatepass").replace(SPACE, " ")[1:]


_codecs: dict[tuple[str | None, int | None], Codec] = {}


def codec(path: str | None = None, most_bytes: int | None = None) -> Codec:
    """The one of this process."""
    keep_only("subword", _codecs.clear)
    if (path, most_bytes) not in _codecs:
        _codecs.clear()
        _codecs[path, most_bytes] = Codec(path, most_bytes)
    return _codecs[path, most_bytes]


def offsets(lists: list) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]), pa.int32())


def listed(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(offsets(arrays), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]), pa.int32()))


def segment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, path: str | None = None, keep: tuple[str, ...] = (), most_bytes: int | None = None) -> DataFrame:
    """One row per input row: id, ``ids``, ``round_trip`` and ``samples``; the columns ``keep`` are carried along.

    ``ids`` is the library's encoding of the whole text, ``round_trip`` whether it and every sample
    decode to the text. ``samples`` holds the top ``k``
    segmentations of its lattice, drawn without replacement: (ids, log_prob, perturbed,
    log_inclusion), the largest perturbed log-probability first. The weights of the pieces are
    Zipf's, by rank. Draws depend on the row's id, the text and ``k`` only, not on partitions.

    Null text counts as empty, which has no pieces and no samples. Where a text has fewer than ``k``
    segmentations all are returned, with inclusion 1. Rows that share id and text share their draws;
    a null id is a seed like others. Texts are segmented whole; an empty table gives no rows. A worker
    keeps ids and lattices of chunks up to ``most_bytes`` (``MOST_BYTES``), and beside that what ``BATCH_CHARS`` code
    points, or one longer text, need.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("seed"), text_of(text_col).alias("text"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    sample = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType())])
    schema = T.StructType([rows.schema["id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType()), T.StructField("samples", T.ArrayType(sample)), *(rows.schema[f"kept_{i}"] for i in range(len(keep)))])
    arrow = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))

    def run(batches):
        spelled = Spelled(codec(path, most_bytes))
        for b in batches:
            texts = b.column(2).to_pylist()
            seeds = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo, hi in batches_of(texts):
                ids, samples = segmented(texts[lo:hi], seeds[lo:hi], k, path, most_bytes)
                back = [spelled.same(t, [x, *(s[0] for s in one)]) for t, x, one in zip(texts[lo:hi], ids, samples, strict=True)]
                some = [s for one in samples for s in one]
                drawn = pa.StructArray.from_arrays([listed([s[0] for s in some]), *(pa.array([s[i] for s in some], pa.float64()) for i in (1, 2, 3))], fields=list(arrow.value_type))
                out = [b.column(0).slice(lo, hi - lo), listed(ids), pa.array(back, pa.bool_()), pa.ListArray.from_arrays(offsets(samples), drawn)]
                out += [b.column(3 + i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, **{f"kept_{i}": c for i, c in enumerate(keep)}})


def segmented(texts: list[str], seeds: np.ndarray, k: int, path: str | None = None, most_bytes: int | None = None):
    """Ids and samples of some texts."""
    c = codec(path, most_bytes)
    kind, kinds, sizes = split_chunks(c, texts)
    if not len(kind):
        return [np.empty(0, np.int32) for _ in texts], [[] for _ in texts]
    kind = c.place_of(kinds)[kind]
    reps = c.n_tokens.a[kind]
    upto = np.cumsum(reps)
    ids = c.tokens.a[np.repeat(c.first_token.a[kind] - (upto - reps), reps) + np.arange(int(upto[-1]))]
    cuts = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], c.sampler.sample(kind, sizes, seeds, k)


def segment_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, path: str | None = None) -> DataFrame:
    """What ``segment`` finds, with digests for the ids: one row per input row.

    ``n_tokens`` and ``ids_sha256`` (of the ids as 32-bit little-endian integers) tell the encoding,
    ``round_trip`` whether it and every sample decode to the text; ``samples`` has for each sample
    (n_pieces, sha256, log_prob, perturbed, log_inclusion). Cases as in ``segment``.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("seed"), text_of(text_col).alias("text"))
    sample = T.StructType([T.StructField("n_pieces", T.LongType()), T.StructField("sha256", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("log_prob", "perturbed", "log_inclusion"))])
    schema = T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType()), T.StructField("samples", T.ArrayType(sample))])
    arrow = pa.list_(pa.struct([("n_pieces", pa.int64()), ("sha256", pa.string()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))
    digest = lambda x: hashlib.sha256(x.astype("<i4").tobytes()).hexdigest()

    def run(batches):
        c = codec(path)
        spelled = Spelled(c)
        for b in batches:
            texts = b.column(2).to_pylist()
            seeds = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo, hi in batches_of(texts):
                ids, samples = segmented(texts[lo:hi], seeds[lo:hi], k, path)
                back = [spelled.same(t, [x, *(s[0] for s in one)]) for t, x, one in zip(texts[lo:hi], ids, samples, strict=True)]
                told = [[{"n_pieces": len(s[0]), "sha256": digest(s[0]), "log_prob": s[1], "perturbed": s[2], "log_inclusion": s[3]} for s in one] for one in samples]
                out = [b.column(0).slice(lo, hi - lo), pa.array([len(x) for x in ids], pa.int64()), pa.array([digest(x) for x in ids], pa.string()), pa.array(back, pa.bool_()), pa.array(told, arrow)]
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


class Spelled:
    """Decodes many ids at once through a table of all pieces' bytes, and compares with a text."""

    def __init__(self, c: Codec) -> None:
        sp = c.sp
        told = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())]
        self.pieces = told

    def same(self, text: str, many: list[np.ndarray]) -> bool:
        want = (" " + text.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if text else b""
        return all(b"".join(map(self.pieces.__getitem__, ids.tolist())) == want for ids in many)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return segment_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""The texts most similar to a query, exactly: upper bounds of the similarity first, the similarity itself for the few left."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Texts of one tree at most, and texts a node from which on they are looked at one by one.
TREE_TEXTS, NODE_TEXTS = 65_536, 24
#: Queries that are searched together, and pairs of query and node that they may have at one depth.
TOGETHER, PAIRS = 64, 1 << 20
#: The similarities asked for first, one after the other, until enough texts reach them; below the last all texts are looked at.
ASKED = (0.84, 0.77, 0.7, 0.64, 0.58, 0.52, 0.46, 0.4)
#: Share of the texts on which ASKED is tried, and times that one letter of a text's end gets a bit of its own.
TRIED, TIMES = 0.1, 8
#: Texts of a tree from which on a query is compared with the tree's ends by itself; a number of letters that no end has.
MANY, NEVER = 8_000, 255
#: Pieces of a query at whose ends the bound of a text's end is taken: for all texts, then for those left.
PIECES = (2, 6)
#: Texts of one table of letter counts, its columns up to which bounds are a matrix product, and queries of one product.
COUNTED, LETTER_COLUMNS, PRODUCT_QUERIES = 20_000, 400, 100


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def score(query: str, candidates: Iterator[tuple[str, float]], best: list[float], have: dict[str, float]) -> None:
    """Put the ratios of ``candidates`` (text, bound; largest bounds first) into ``have``, as long as bounds reach ``best``."""
    for text, bound in candidates:
        if bound < best[0]:
            break
        if text not in have:
            have[text] = ratio(query, text)
            heapq.heappushpop(best, have[text])


class Tree:
    """Texts of one length in order, as a tree of their beginnings; ``ends`` has the letters after those as bits."""

    def __init__(self, texts: list[str], codes: np.ndarray):
        self.texts, self.codes, self.size = texts, codes, len(codes)
        new, starts = np.zeros(len(texts), dtype=bool), []
        new[0] = True
        for place in codes:
            new[1:] |= place[1:] != place[:-1]
            starts.append(np.flatnonzero(new))
            if len(starts[-1]) * NODE_TEXTS >= len(texts):
                break
        self.letters = [codes[d][at] for d, at in enumerate(starts)]
        self.kids = [np.searchsorted(then, np.append(at, len(texts))) for at, then in zip(starts, starts[1:])]
        self.first, self.depth, self.ends = np.append(starts[-1], len(texts)), len(starts), None
        self.names = np.diff(self.first)

    def times(self) -> np.ndarray:
        """How often each letter of the ends stands earlier in its end, up to TIMES."""
        end = self.codes[self.depth :]
        out = np.zeros(end.shape, dtype=np.uint8)
        for p in range(1, len(end)):
            for o in range(p):
                out[p] += end[o] == end[p]
        return np.minimum(out, TIMES)


class Similar:
    """Distinct texts that are searched for the ones most similar to queries, all of them.

    Matched letters are a common subsequence, so the longest one bounds the ratio. It is computed bit by bit (bit i of a row is
    the query's letter i) along trees of beginnings; what is left of a text adds no more than the letters that it shares with
    the rest of the query. Texts whose bound is under the least similarity that still counts are left out exactly.
    """

    def __init__(self, texts: list[str]):
        self.texts = sorted(texts, key=lambda t: (len(t), t))
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(texts))))}
        plain = np.zeros(max(map(ord, self.letters), default=0) + 1, dtype=np.min_scalar_type(len(self.letters)))
        for c, i in self.letters.items():
            plain[ord(c)] = i
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.trees: list[Tree] = []
        for size in np.unique(sizes[sizes > 0]):
            low, high = np.searchsorted(sizes, [size, size + 1])
            for at in range(low, high, TREE_TEXTS):
                some = self.texts[at : min(at + TREE_TEXTS, high)]
                codes = plain[np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32)].reshape(len(some), size)
                self.trees.append(Tree(some, np.ascontiguousarray(codes.T)))
        self._bits()

    def _bits(self) -> None:
        """64 bits for the letters (and times of a letter) that ends hold most; the others are taken as shared."""
        wide, times = TIMES + 1, [tree.times() for tree in self.trees]
        seen = np.zeros(len(self.letters) * wide, dtype=np.int64)
        for tree, t in zip(self.trees, times):
            seen += np.bincount(tree.codes[tree.depth :].ravel().astype(np.int64) * wide + t.ravel(), minlength=len(seen))
        seen[TIMES::wide] = 0
        self.bit = np.zeros(len(seen), dtype=np.uint64)
        for k, i in enumerate(np.argsort(-seen, kind="stable")[:64]):
            self.bit[i] = np.uint64((1 << k) if seen[i] else 0)
        self.bit = self.bit.reshape(-1, wide)
        for tree, t in zip(self.trees, times):
            tree.ends = np.zeros(len(tree.texts), dtype=np.uint64)
            for place, n in zip(tree.codes[tree.depth :], t):
                tree.ends |= self.bit[place, n]

    def top(self, queries: list[str], best: dict[str, list[float]]) -> dict[str, dict[str, float]]:
        """By query, the ratio of every text that is not below the n-th best, and of some others.

        ``best`` has for each query a heap of the n best ratios known of other texts (or the least that counts); it is kept up to date.
        """
        have: dict[str, dict[str, float]] = {q: {} for q in queries}
        by_size: dict[int, list[str]] = {}
        for q in queries:
            by_size.setdefault(len(q) if len(q) <= 64 else 0, []).append(q)
        rest = by_size.pop(0, [])
        most = max((len(x) for tree in self.trees for x in tree.letters), default=1)
        together = max(1, min(TOGETHER, PAIRS // most))
        for some in by_size.values():
            for i in range(0, len(some), together):
                rest += self._search(some[i : i + together], best, have)
        for at in range(0, len(self.texts) if rest else 0, COUNTED):
            counted = Counted(self.texts[at : at + COUNTED])
            for q, shared in zip(rest, counted.shared_of_all(rest)):
                counted.top(q, best[q], have[q], shared)
        return have

    def _search(self, queries: list[str], best: dict[str, list[float]], have: dict[str, dict[str, float]]) -> list[str]:
        """Fill ``have`` for queries of one length; gives those that are so unlike all texts that bounds don't help."""
        asked = Asked(queries, self)
        trees = sorted(self.trees, key=lambda t: abs(t.size - asked.size))
        tried, enough = 0, TRIED * len(self.texts)
        while tried < len(trees) and sum(len(t.texts) for t in trees[:tried]) < enough:
            tried += 1
        known = np.array([best[q][0] for q in queries])
        told, todo = known > 0, np.flatnonzero(known <= 0)
        for least in ASKED:
            if not len(todo):
                break
            for tree in trees[:tried]:
                known[todo] = [max(least, best[queries[i]][0]) for i in todo]
                self._tree(tree, asked, todo, known, best, have)
            todo = todo[[best[queries[i]][0] < least for i in todo]]
        done = np.setdiff1d(np.arange(len(queries)), todo)
        for k, tree in enumerate(trees):
            at = done if k >= tried else done[told[done]]
            if len(at):
                known[at] = [best[queries[i]][0] for i in at]
                self._tree(tree, asked, at, known, best, have)
        return [queries[i] for i in todo]

    def _tree(self, tree: Tree, asked: Asked, at: np.ndarray, known: np.ndarray, best: dict[str, list[float]], have: dict[str, dict[str, float]]) -> None:
        """Score the texts of ``tree`` whose bound reaches ``known``, for the queries ``at``."""
        n, size = asked.size, tree.size
        need = np.ceil(known * (n + size) / 2 - 1e-9).astype(np.int16)
        at = at[need[at] <= min(n, size)]
        q, node = np.repeat(at, len(tree.letters[0])), np.tile(np.arange(len(tree.letters[0])), len(at))
        row = np.full(len(q), asked.full, dtype=asked.kind)
        for d, letters in enumerate(tree.letters):
            if d:
                first = tree.kids[d - 1].take(node)
                count = tree.kids[d - 1].take(node + 1) - first
                node = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                q, row = np.repeat(q, count), np.repeat(row, count)
            row = asked.step(row, q, letters.take(node))
            left = size - d - 1
            if left < n:
                ok = np.flatnonzero(asked.matched(row, n - left) + left >= need.take(q))
                q, node, row = q[ok], node[ok], row[ok]
        q, name, row = self._ends(tree, asked, need, q, node, row)
        for place in tree.codes[tree.depth :]:
            row = asked.step(row, q, place.take(name))
        found = asked.matched(row, n)
        ok = np.flatnonzero(found >= need.take(q))
        ok = ok[np.lexsort((-found[ok].astype(np.int16), q[ok]))]
        bounds = (2.0 * found[ok] / (n + size)).tolist()
        hits: dict[int, list[tuple[str, float]]] = {}
        for i, j, bound in zip(q[ok].tolist(), name[ok].tolist(), bounds):
            hits.setdefault(i, []).append((tree.texts[j], bound))
        for i, some in hits.items():
            score(asked.queries[i], iter(some), best[asked.queries[i]], have[asked.queries[i]])

    def _ends(self, tree: Tree, asked: Asked, need: np.ndarray, q: np.ndarray, node: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, text and row of the texts under ``node`` whose beginning's matches and end's letters may come to ``need``.

        If the end goes on in a piece of the query, the beginning has matches up to that piece's end at most, and the end shares
        letters from that piece's start on.
        """
        lacks = self._lacks(tree, asked, asked.pieces[0], need, q, row)
        ok = np.flatnonzero((lacks < NEVER).any(axis=0))
        q, node, row, lacks = q[ok], node[ok], row[ok], lacks[:, ok]
        first = tree.first.take(node)
        count = tree.first.take(node + 1) - first
        names = np.bincount(q, count, minlength=len(need))
        many = names.take(q) > MANY
        at = np.flatnonzero(~many)
        of = np.repeat(at, count[at])
        name = np.repeat((first - (np.cumsum(np.where(many, 0, count)) - count))[at], count[at]) + np.arange(len(of))
        ends, of_query = tree.ends.take(name), q.take(of)
        ok = np.zeros(len(of), dtype=bool)
        for (_, _, bits, _), least in zip(asked.pieces[0], lacks):
            ok |= np.bitwise_count(ends & bits.take(of_query)) >= least.take(of)
        found = [(name[ok], of[ok])]
        for i in np.flatnonzero(names > MANY).tolist():  # one at a time: the query's bits are numbers then
            low, high = np.searchsorted(q, [i, i + 1])
            ok, some = np.zeros(len(tree.texts), dtype=bool), np.empty(len(tree.texts), dtype=np.uint64)
            for (_, _, bits, _), least in zip(asked.pieces[0], lacks[:, low:high]):
                if (least < NEVER).any():
                    lack = np.full(len(tree.names), NEVER, dtype=np.uint8)
                    lack[node[low:high]] = least
                    ok |= np.bitwise_count(np.bitwise_and(tree.ends, bits[i], out=some)) >= np.repeat(lack, tree.names)
            name = np.flatnonzero(ok)
            place = np.zeros(len(tree.first), dtype=np.intp)
            place[node[low:high]] = np.arange(low, high)
            found.append((name, place.take(np.searchsorted(tree.first, name, side="right") - 1)))
        name, of = (np.concatenate(x) for x in zip(*found))
        for pieces in asked.pieces[1:]:
            some, at = np.unique(of, return_inverse=True)
            lacks = self._lacks(tree, asked, pieces, need, q[some], row[some])
            ends, of_query = tree.ends.take(name), q.take(of)
            ok = np.zeros(len(of), dtype=bool)
            for (_, _, bits, _), least in zip(pieces, lacks):
                ok |= np.bitwise_count(ends & bits.take(of_query)) >= least.take(at)
            name, of = name[ok], of[ok]
        return q.take(of), name, row.take(of)

    @staticmethod
    def _lacks(tree: Tree, asked: Asked, pieces: list[tuple], need: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
        """By piece, the letters that an end must share (NEVER if it has too few) after each row."""
        out = np.empty((len(pieces), len(q)), dtype=np.uint8)
        needs = need.take(q)
        for k, (start, stop, _, others) in enumerate(pieces):
            more = needs - asked.matched(row, stop)
            out[k] = np.where(more > min(tree.size - tree.depth, asked.size - start), NEVER, np.maximum(more - others.take(q), 0))
        return out


class Counted:
    """Texts that are searched for the ones most similar to a query, by upper bounds of ``ratio`` and then by itself.

    Matched letters are a common subsequence, so neither the letters that both texts have nor the longest common
    subsequence is below them: texts whose bound is under the least similarity that still counts are left out exactly.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(texts))), 1)}
        self.codes = np.zeros((int(self.size.max(initial=0)), len(texts)), dtype=np.int32)  # by place; 0 is no letter
        for j, t in enumerate(texts):
            self.codes[: len(t), j] = [self.letters[c] for c in t]
        self.counts = np.stack([(self.codes == i).sum(axis=0, dtype=np.int32) for i in range(1, len(self.letters) + 1)]) if self.letters else None
        most = [int(n) for n in self.counts.max(axis=1)] if self.letters else []
        self.columns = [(c, n) for c, i in self.letters.items() for n in range(1, most[i - 1] + 1)] if sum(most) <= LETTER_COLUMNS else None
        if self.columns:
            self.table = np.stack([self.counts[self.letters[c] - 1] >= n for c, n in self.columns]).astype(np.float32)

    def shared(self, query: str) -> np.ndarray:
        """Letters that each text has in common with ``query``, in any order."""
        out = np.zeros(len(self.texts), dtype=np.int64)
        for c in set(query) & set(self.letters):
            out += np.minimum(self.counts[self.letters[c] - 1], query.count(c))
        return out

    def in_order(self, query: str, at: np.ndarray) -> np.ndarray:
        """Longest common subsequence of ``query`` (64 letters at most) with the texts ``at``: bit i of a row is its letter i."""
        masks = np.zeros(len(self.letters) + 1, dtype=np.uint64)
        for i, c in enumerate(query):
            if c in self.letters:
                masks[self.letters[c]] |= np.uint64(1 << i)
        row = np.full(len(at), np.iinfo(np.uint64).max, dtype=np.uint64)
        for place in self.codes[: self.size[at].max(initial=0)]:
            hit = row & masks[place[at]]
            row = (row + hit) | (row - hit)
        return np.bitwise_count(~row & np.uint64((1 << len(query)) - 1)).astype(np.int64)

    def shared_of_all(self, queries: list[str]) -> Iterator[np.ndarray]:
        """``shared`` of each query; the smaller count of a letter is the number of n that neither count is below."""
        for i in range(0, len(queries), PRODUCT_QUERIES):
            some = queries[i : i + PRODUCT_QUERIES]
            if self.columns:
                yield from np.array([[q.count(c) >= n for c, n in self.columns] for q in some], dtype=np.float32) @ self.table
            else:
                yield from map(self.shared, some)

    def top(self, query: str, best: list[float], have: dict[str, float], shared: np.ndarray) -> None:
        """Put the ratio of every text that is not below the n-th best into ``have``, and of some others.

        ``best`` is a heap of the ``n`` best ratios known, those in ``have`` included; it is kept up to date. ``shared`` is what
        ``shared`` gives.
        """
        total, n = np.maximum(self.size + len(query), 1), len(best)
        bound = np.where(self.size + len(query) == 0, 1.0, 2.0 * shared / total)
        short = 0 < len(query) <= 64
        seeds = np.argpartition(-bound, 100 * n)[: 100 * n] if len(bound) > 100 * n else np.arange(len(bound))
        order = self.in_order(query, seeds) / total[seeds] if short and len(seeds) else bound[seeds]
        for k in np.argsort(-order)[: 2 * n]:
            score(query, iter([(self.texts[seeds[k]], 1.0)]), best, have)
        at = np.flatnonzero(bound >= best[0] * (1 - 1e-9))
        bound = bound[at]
        if short and len(at):
            bound = 2.0 * self.in_order(query, at) / total[at]
        order = np.argsort(-bound, kind="stable")
        score(query, ((self.texts[at[k]], bound[k]) for k in order), best, have)


class Asked:
    """Queries of one length (64 letters at most) as bits: of each letter's places, and of the letters from a place on."""

    def __init__(self, queries: list[str], texts: Similar):
        self.queries, self.size = queries, len(queries[0])
        self.kind = np.uint32 if self.size <= 32 else np.uint64
        self.full, self.wide = self.kind((1 << self.size) - 1), max(1, len(texts.letters))
        codes = [[texts.letters.get(c, -1) for c in q] for q in queries]
        masks = np.zeros((len(queries), self.wide), dtype=self.kind)
        for mask, letters in zip(masks, codes):
            for place, c in enumerate(letters):
                if c >= 0:
                    mask[c] |= self.kind(1 << place)
        self.flat, self.pieces = masks.ravel(), []
        for n in PIECES:
            starts = sorted({self.size * k // n for k in range(n)})
            stops = [*(s - 1 for s in starts[1:]), self.size]
            both = np.array([[self._letters(letters[s:], texts.bit) for letters in codes] for s in starts], dtype=np.uint64)
            self.pieces.append([(s, e, np.ascontiguousarray(x[:, 0]), x[:, 1].astype(np.int16)) for s, e, x in zip(starts, stops, both)])

    @staticmethod
    def _letters(codes: list[int], bit: np.ndarray) -> tuple[int, int]:
        """Bits of the letters, and the number of those that have none."""
        out, others, times = 0, 0, {}
        for c in codes:
            if c >= 0:
                times[c] = t = times.get(c, -1) + 1
                b = int(bit[c, min(t, TIMES)])
                out, others = out | b, others + (not b)
        return out, others

    def step(self, row: np.ndarray, q: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Rows of the longest common subsequence after one more letter."""
        hit = row & self.flat.take(q * self.wide + letter)
        return (row + hit) | (row - hit)

    def matched(self, row: np.ndarray, places: int) -> np.ndarray:
        """Its length with the first ``places`` letters of the query."""
        return np.bitwise_count(~row & self.kind((1 << places) - 1))

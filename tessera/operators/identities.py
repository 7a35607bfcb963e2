"""Identities inside one file: weak tracks attached, fragments joined, a hint of their number met; compatible parts of a cluster.

Arrays of one file's tracks: `banks` holds a few unit vectors of each, `label` its identity or -1, `cannot` which two
are kept apart (they share a moment, or have different names).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import pair_score, score_strips, sharing, stitched
from .curation import guard

# The least similarity to stitch, to attach by several pairs, to attach by one pair, and to track; the margin over
# the second best; the size of a bank; the pairs of a score.
STITCH, ATTACH, SINGLE, TRACKING = 0.65, 0.72, 0.78, 0.35
MARGIN = 0.08
BANK, PAIRS = 5, 3
SAME = 0.9999
# The bonus of a track that begins within so many seconds where another ended, by the overlap of their boxes.
BONUS, SOON, PLACE = 0.02, 1.2, 0.3


def varied(quality: np.ndarray, vectors: np.ndarray, most: int = BANK) -> list[int]:
    """Positions of a few samples by quality, lowered by half as far as a sample is like a chosen one; none that equals a chosen one."""
    free, like, chosen = np.ones(len(quality), bool), np.zeros(len(quality)), []
    while free.any() and len(chosen) < most:
        at = np.flatnonzero(free)
        worth = quality[at] * (1 - like[at] / 2)
        i = int(at[np.lexsort((-quality[at], -worth))[0]])
        free[i] = False
        if not chosen or like[i] < SAME:
            like = np.maximum(like, vectors @ vectors[i]) if chosen else vectors @ vectors[i]
            chosen.append(i)
    return chosen


def _enough(support: int, several: float = ATTACH, single: float = SINGLE) -> float:
    return several if support > 1 else single


def attached(banks: list[np.ndarray], label: np.ndarray, cannot: np.ndarray, several: float = ATTACH, single: float = SINGLE) -> np.ndarray:
    """Labels after each track without one has joined the identity that it is surely like.

    A track is as like an identity as the identity's least like core; the best identity must reach the threshold and beat the second
    by the margin. Only cores are compared, so an attached track does not draw others, but what it is kept apart from stays out.
    """
    cores, weak, out = np.flatnonzero(label >= 0), np.flatnonzero(label < 0), label.copy()
    size = np.array([len(b) for b in banks], int)
    scores = ((w, row) for rows, found in score_strips([banks[w] for w in weak], [banks[c] for c in cores], PAIRS) for w, row in zip(weak[rows], found, strict=True))
    for w, score in scores:
        support = np.minimum(np.minimum(PAIRS, size[w]), size[cores])
        order = np.lexsort((support, score, label[cores]))
        identity, first = np.unique(label[cores][order], return_index=True)
        free = np.flatnonzero(~np.isin(identity, out[cannot[w]]))
        least = score[order][first]
        ranked = free[np.argsort(-least[free], kind="stable")]
        if len(ranked):
            second = least[ranked[1]] if len(ranked) > 1 else -1.0
            best = ranked[0]
            if least[best] >= _enough(support[order][first][best], several, single) and least[best] - second >= MARGIN:
                out[w] = identity[best]
    return out


def joined(banks: list[np.ndarray], label: np.ndarray, core: np.ndarray, views: dict[int, tuple[np.ndarray, np.ndarray]], cannot: np.ndarray, target: int | None = None) -> np.ndarray:
    """Labels after identities that several views show to be one have been joined, the most alike first, until none are or `target` are left.

    views: (quality, vectors) of the samples of each core track. No two cores of the joined may be clearly different, and none of their
    members kept apart.
    """
    out = label.copy()

    def bank(g: int) -> np.ndarray:
        rows = [views[i] for i in np.flatnonzero((out == g) & core)]
        quality, vectors = np.concatenate([q for q, _ in rows]), np.vstack([v for _, v in rows])
        return vectors[varied(quality, vectors)]

    shown = {int(g): bank(g) for g in np.unique(out[core & (out >= 0)])}

    def alike(some: list[int], ahead: bool = False) -> dict[tuple[int, int], float]:
        """The pairs of some identities with the others that are enough alike and not kept apart; with `ahead` with those of larger numbers."""
        found, every = {}, sorted(shown)
        size = np.array([len(shown[g]) for g in every], int)
        for rows, scores in score_strips([shown[g] for g in some], [shown[g] for g in every], PAIRS):
            for i, j in zip(*np.nonzero(scores >= min(ATTACH, SINGLE)), strict=True):
                a, b, score = some[rows[i]], every[j], float(scores[i, j])
                if a == b or (ahead and b < a) or score < _enough(min(PAIRS, len(shown[a]), int(size[j]))):
                    continue
                of_a, of_b = np.flatnonzero(out == a), np.flatnonzero(out == b)
                if not cannot[np.ix_(of_a, of_b)].any() and all(pair_score(banks[x], banks[y], PAIRS) >= STITCH - MARGIN for x in of_a[core[of_a]] for y in of_b[core[of_b]]):
                    found[min(a, b), max(a, b)] = score
        return found

    likes = alike(sorted(shown), True)
    while likes and (target is None or len(shown) > target):
        a, b = min(likes, key=lambda pair: (-likes[pair], pair))
        out[out == b] = a
        del shown[b]
        shown[a] = bank(a)
        likes = {pair: s for pair, s in likes.items() if b not in pair and a not in pair} | alike([a])
    return out


def hinted(banks: list[np.ndarray], label: np.ndarray, cannot: np.ndarray, target: int) -> np.ndarray:
    """Labels (0, 1, ...) after the tracks without one have been dealt to `target` identities, those with most conflicts first.

    A track goes to the likest of the identities that it can be tracked to; if there is none, to the first that is still empty; else to the
    likest that it isn't barred from; and where it is barred from all, to a new one.
    """
    out = label.copy()
    loose = np.flatnonzero(label < 0)
    if not len(loose):
        return out
    width = max(target, label.max(initial=-1) + 1)
    size = np.array([len(banks[w]) for w in loose])
    place = np.repeat(np.arange(len(loose)), size), np.concatenate([np.arange(n) for n in size])  # of each vector: its track, and its row there
    rows = np.vstack([banks[w] for w in loose])
    tops: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def shown(g: int, new: np.ndarray) -> np.ndarray:
        """Likeness of the loose tracks to an identity that gets new views. Of its views the likest PAIRS of each vector are all that pairs are made of."""
        sims, at, n = tops.get(g, (np.zeros((len(rows), 0)), np.zeros((len(rows), 0), int), 0))
        sims, at = np.hstack((sims, rows @ new.T)), np.hstack((at, np.broadcast_to(np.arange(n, n + len(new)), (len(rows), len(new)))))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :PAIRS]
        sims, at = np.take_along_axis(sims, order, axis=1), np.take_along_axis(at, order, axis=1)
        tops[g] = sims, at, n + len(new)
        full, view = np.full((len(loose), size.max(), sims.shape[1]), -np.inf), np.full((len(loose), size.max(), sims.shape[1]), -1)
        full[place], view[place] = sims, at
        cell = np.arange(full.shape[1] * full.shape[2]) // full.shape[2]
        full, view = full.reshape(len(loose), -1), view.reshape(len(loose), -1)
        total, count = np.zeros(len(loose)), np.zeros(len(loose))
        for _ in range(PAIRS):
            best = full.argmax(axis=1)[:, None]
            value = np.take_along_axis(full, best, axis=1)[:, 0]
            met = np.isfinite(value)
            total[met] += value[met]
            count += met
            full = np.where((cell == cell[best]) | (view == np.take_along_axis(view, best, axis=1)), -np.inf, full)
        return np.where(count > 0, total / np.maximum(count, 1), -1.0)

    # Of the loose tracks against the identities: likeness, and whether a member is kept apart from the track.
    like, barred = np.full((len(loose), width + len(loose)), -np.inf), np.zeros((len(loose), width + len(loose)), bool)
    for g in range(width):
        members = np.flatnonzero(label == g)
        if len(members):
            like[:, g] = shown(g, np.vstack([banks[m] for m in members]))
            barred[:, g] = cannot[np.ix_(loose, members)].any(axis=1)
    for k in np.argsort(-cannot[np.ix_(loose, loose)].sum(axis=1), kind="stable"):
        own = like[k, :width]
        free, empty = ~barred[k, :width], np.isneginf(own)
        choices = [np.where(free & (own >= TRACKING), own, -np.inf), np.where(free & empty, 0.0, -np.inf), np.where(free & ~empty, own, -np.inf)]
        g = next((int(c.argmax()) for c in choices if np.isfinite(c).any()), width)
        width = max(width, g + 1)
        out[loose[k]] = g
        like[:, g] = shown(g, banks[loose[k]])
        barred[:, g] |= cannot[loose, loose[k]]
    return out


def first_fit(vectors: np.ndarray, floor: float) -> np.ndarray:
    """Part of each vector: the first part of which every member is as like it as floor, else a new one.

    A vector fits the parts all of whose members are among those that are like it; of each pair nothing is held.
    """
    n, parts = len(vectors), 0
    part, size = np.zeros(n, int), np.zeros(n, int)
    strip = max(1, min(256, 8_000_000 // max(n, 1)))
    for start in range(0, n, strip):
        like = vectors[start : start + strip] @ vectors[: start + strip].T >= floor
        for i in range(start, min(start + strip, n)):
            met = np.bincount(part[np.flatnonzero(like[i - start, :i])], minlength=parts)[:parts]
            fits = np.flatnonzero((met == size[:parts]) & (met > 0))
            part[i] = fits[0] if len(fits) else parts
            parts = max(parts, int(part[i]) + 1)
            size[part[i]] += 1
    return part


def _units(vectors: pd.Series) -> np.ndarray:
    rows = np.array([np.asarray(x, float) for x in vectors])
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _iou(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return 0.0
    sides = np.maximum(0.0, np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2]))
    common = float(sides.prod())
    union = float((a[2:] - a[:2]).prod() + (b[2:] - b[:2]).prod()) - common
    return common / union if union > 0 else 0.0


def followed(tracks: list[pd.DataFrame], box: str) -> np.ndarray:
    """The bonus of two tracks of which one begins soon after the other ends, where that was."""
    spans = []
    for rows in tracks:
        known = rows[rows["ts"].notna()]
        ends = [None if not len(known) or known[box].iloc[i] is None else np.asarray(known[box].iloc[i], float) for i in (0, -1)]
        spans.append((known["ts"].min(), known["ts"].max(), *ends) if len(known) else None)
    out = np.zeros((len(spans), len(spans)))
    for i, a in enumerate(spans):
        for j, b in enumerate(spans):
            if i != j and a and b and 0 <= b[0] - a[1] <= SOON and _iou(a[3], b[2]) >= PLACE:
                out[i, j] = out[j, i] = BONUS
    return out


def file_identities(df: DataFrame, group: str, floor: float = STITCH, people: str | None = None, person: str | None = None, apart: str | None = None, box: str | None = None) -> DataFrame:
    """(group, track, identity, role) of samples (group, track, ts, quality, core, vector): role is core, attached, hinted or open.

    Core tracks are stitched, weak ones attached, fragments joined; where the column `people` gives a number of identities, the
    joining ends there and what is open is dealt out. Samples without track or vector take no part; tracks that share a moment are
    kept apart, and so are those of different names (column `person`) and those that share a scene (column `apart`, an array of strings). With
    the column `box` (left, top, right, bottom) tracks that follow one another in one place are stitched before equally like ones.
    An open track has identity -1. A group above the guard's number of rows is refused.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        guard(g)
        g = g.sort_values(["track", "ts", "quality"], ascending=[True, True, False])
        tracks = list(g.groupby("track"))
        views = {i: (rows["quality"].fillna(0).to_numpy(float), _units(rows["vector"])) for i, (_, rows) in enumerate(tracks)}
        banks = [v[varied(q, v)] for q, v in views.values()]
        core = np.array([bool(rows["core"].fillna(False).astype(bool).any()) for _, rows in tracks])
        moments = [set(rows["ts"].dropna()) for _, rows in tracks]
        if apart:
            moments = [own.union(*(x for x in rows[apart] if x is not None)) for own, (_, rows) in zip(moments, tracks, strict=True)]
        cannot = sharing(moments)(np.arange(len(moments)))
        if person:
            names = pd.factorize(pd.Series([rows[person].dropna().min() if rows[person].notna().any() else None for _, rows in tracks], dtype=object))[0]
            cannot |= (names[:, None] >= 0) & (names >= 0) & (names[:, None] != names)
        at, label = np.flatnonzero(core), np.full(len(tracks), -1)
        if len(at):
            barred = lambda some: cannot[np.ix_(at[some], at)]
            bonus = followed([tracks[i][1] for i in at], box) if box else None
            label[at] = stitched([banks[i] for i in at], barred, floor, bonus)
        hint = g[people].max() if people else None
        hint = None if hint is None or pd.isna(hint) else int(hint)
        sure = joined(banks, attached(banks, label, cannot), core, views, cannot, hint)
        sure[sure >= 0] = np.unique(sure[sure >= 0], return_inverse=True)[1]
        out = sure if hint is None else hinted(banks, sure, cannot, hint)
        role = np.select([core, sure >= 0, out >= 0], ["core", "attached", "hinted"], "open")
        return pd.DataFrame({group: g[group].iloc[0], "track": [k for k, _ in tracks], "identity": out, "role": role})

    columns = [group, "track", "ts", "quality", "core", "vector", *(c for c in (people, person, apart, box) if c)]
    rows = df.select(*columns).where(F.col("track").isNotNull() & F.col("vector").isNotNull())
    return rows.groupBy(group).applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, track long, identity long, role string")


def compatible_parts(df: DataFrame, group: str, floor: float) -> DataFrame:
    """(group, key, part) of rows (group, key, vector): each group in order of its keys, cut into parts all of whose members are alike."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("key")
        return pd.DataFrame({group: g[group].iloc[0], "key": g["key"].to_numpy(), "part": first_fit(_units(g["vector"]), floor)})

    rows = df.select(group, "key", "vector").where(F.col("vector").isNotNull())
    return rows.groupBy(group).applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, key long, part long")

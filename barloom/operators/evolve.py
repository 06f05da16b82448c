"""Search loop on the driver: small populations, one Spark job a generation."""

from __future__ import annotations

import random
from collections.abc import Callable

Genes = tuple[int, ...]
Scores = tuple[float, ...]


def softmax_weights(relevance: list[float], floor: float = 0.1) -> list[float]:
    """Sampling weights: softmax mixed with a uniform share."""
    import math

    top = max(relevance, default=0.0)
    e = [math.exp(x - top) for x in relevance]
    return [(1 - floor) * x / sum(e) + floor / len(e) for x in e]


def random_genes(r: random.Random, classes: list[int], weights: list[float], low: int = 2, high: int = 4) -> Genes:
    """low to high active genes, features drawn by weight; the rest don't care (= classes)."""
    genes, left, w = list(classes), list(range(len(classes))), list(weights)
    for _ in range(min(r.randint(low, high), len(classes))):
        k = r.choices(range(len(left)), w)[0]
        i = left.pop(k)
        w.pop(k)
        genes[i] = r.randrange(classes[i])
    return tuple(genes)


def repair(r: random.Random, genes: Genes, classes: list[int], low: int = 2, high: int = 4) -> Genes:
    g = list(genes)
    active = [i for i, x in enumerate(g) if x != classes[i]]
    r.shuffle(active)
    for i in active[high:]:
        g[i] = classes[i]
    idle = [i for i in range(len(g)) if g[i] == classes[i]]
    r.shuffle(idle)
    for i in idle[: max(0, low - len(active))]:
        g[i] = r.randrange(classes[i])
    return tuple(g)


def crossover(r: random.Random, a: Genes, b: Genes) -> Genes:
    return tuple(x if r.random() < 0.5 else y for x, y in zip(a, b, strict=True))


def mutate(r: random.Random, genes: Genes, classes: list[int], rate: float) -> Genes:
    return tuple(r.randint(0, classes[i]) if r.random() < rate else g for i, g in enumerate(genes))


def beats(a: Scores, b: Scores) -> bool:
    return all(x <= y for x, y in zip(a, b, strict=True)) and a != b


def ranked(scores: list[Scores]) -> list[int]:
    """Front numbers from 0."""
    left, front, out = set(range(len(scores))), 0, [0] * len(scores)
    while left:
        best = {i for i in left if not any(beats(scores[j], scores[i]) for j in left if j != i)}
        for i in best:
            out[i] = front
        left -= best
        front += 1
    return out


def spread(scores: list[Scores], front: list[int]) -> list[float]:
    gap = [0.0] * len(scores)
    for f in set(front):
        mine = [i for i in range(len(scores)) if front[i] == f]
        for k in range(len(scores[0])):
            mine.sort(key=lambda i, k=k: scores[i][k])
            width = scores[mine[-1]][k] - scores[mine[0]][k] or 1.0
            gap[mine[0]] = gap[mine[-1]] = float("inf")
            for a, b, c in zip(mine, mine[1:], mine[2:], strict=False):
                gap[b] += (scores[c][k] - scores[a][k]) / width
    return gap


def survivors(population: list[Genes], scores: list[Scores], n: int) -> list[int]:
    front, order = ranked(scores), []
    gap = spread(scores, front)
    seen: set[Genes] = set()
    for i in sorted(range(len(population)), key=lambda i: (front[i], -gap[i], population[i])):
        if population[i] not in seen:
            seen.add(population[i])
            order.append(i)
    return order[:n]


def reference_points(objectives: int, divisions: int) -> list[tuple[float, ...]]:
    """Evenly spread points of the unit simplex (Das and Dennis)."""
    def split(left: int, k: int) -> list[tuple[int, ...]]:
        return [(left,)] if k == 1 else [(i, *rest) for i in range(left + 1) for rest in split(left - i, k - 1)]

    return [tuple(x / divisions for x in p) for p in split(divisions, objectives)]


def niche_survivors(scores: list[Scores], n: int, points: list[tuple[float, ...]], seed: int = 0) -> list[int]:
    """NSGA-III: whole fronts while they fit; of the last one, members of the reference directions
    that have fewest survivors, nearest first where a direction has none."""
    import numpy as np

    r, front = random.Random(seed), ranked(scores)
    chosen: list[int] = []
    last: list[int] = []
    for f in range(max(front, default=-1) + 1):
        mine = [i for i in range(len(scores)) if front[i] == f]
        if len(chosen) + len(mine) > n:
            last = mine
            break
        chosen += mine
    if not last or len(chosen) == n:
        return chosen[:n]
    pool = chosen + last
    x = np.array([scores[i] for i in pool], float)
    x = x - x.min(axis=0)
    # Intercepts of the plane through the extreme points; the ranges where that is degenerate.
    extreme = [int(np.argmin((x / np.where(np.eye(x.shape[1])[k] > 0, 1, 1e-6)).max(axis=1))) for k in range(x.shape[1])]
    try:
        cut = 1 / np.linalg.solve(x[extreme], np.ones(x.shape[1]))
        if not (np.isfinite(cut).all() and (cut > 1e-9).all()):
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        cut = np.maximum(x.max(axis=0), 1e-9)
    x = x / cut
    d = np.array(points, float)
    d = d / np.linalg.norm(d, axis=1, keepdims=True)
    along = x @ d.T
    far = np.sqrt(np.maximum((x * x).sum(axis=1, keepdims=True) - along**2, 0))
    near, gap = far.argmin(axis=1), far.min(axis=1)
    held = np.bincount(near[: len(chosen)], minlength=len(points))
    left = list(range(len(chosen), len(pool)))
    while len(chosen) < n:
        open_ = sorted({int(near[k]) for k in left}, key=lambda j: (held[j], j))
        niche = r.choice([j for j in open_ if held[j] == held[open_[0]]])
        mine = [k for k in left if near[k] == niche]
        k = min(mine, key=lambda k: (gap[k], k)) if held[niche] == 0 else r.choice(mine)
        chosen.append(pool[k])
        held[niche] += 1
        left.remove(k)
    return chosen


class Cache:
    """Scores by genes; the oldest unused ones go beyond `limit`."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.kept = limit, {}

    def scored(self, genes: list[Genes], evaluate: Callable[[list[Genes]], list[Scores]]) -> list[Scores]:
        new = [g for g in dict.fromkeys(genes) if g not in self.kept]
        fresh = dict(zip(new, evaluate(new), strict=True)) if new else {}
        out = [fresh[g] if g in fresh else self.kept[g] for g in genes]
        for g, s in zip(genes, out, strict=True):
            self.kept.pop(g, None)
            self.kept[g] = s
        while len(self.kept) > self.limit:
            del self.kept[next(iter(self.kept))]
        return out


def evolve(
    evaluate: Callable[[list[Genes]], list[Scores]], classes: list[int], weights: list[float], size: int = 24, generations: int = 5, seed: int = 1, patience: int = 3,
    *, points: list[tuple[float, ...]] | None = None, state: dict | None = None, cache: Cache | None = None, seeds: list[Genes] = (),
) -> list[tuple[Genes, Scores]]:
    """Minimise all objectives. evaluate scores the unseen genes of a generation in one job;
    known ones come from the cache. Stops early when the first front stays as it is. points: survivors
    by reference directions rather than crowding. state: a dictionary that is filled after each
    generation; handed in again (it is plain JSON) the search goes on where it stopped."""
    cache = cache or Cache()
    scored = lambda genes: cache.scored(genes, evaluate)
    state = {} if state is None else state
    done = state.get("generation", 0)
    if done:
        pop, idle, last = [tuple(g) for g in state["population"]], state["idle"], frozenset(map(tuple, state["best"]))
    else:
        r = random.Random(f"{seed}|0")
        pop = list(dict.fromkeys([*map(tuple, seeds), *(random_genes(r, classes, weights) for _ in range(size))]))[: max(size, len(seeds))]
        idle, last = 0, None
    for generation in range(done, generations):
        if idle >= patience:
            break
        r = random.Random(f"{seed}|{generation + 1}")
        front = ranked(scored(pop))
        pick = lambda: min(r.sample(range(len(pop)), min(2, len(pop))), key=lambda i: front[i])  # noqa: B023, E731
        young = [repair(r, mutate(r, crossover(r, pop[pick()], pop[pick()]), classes, 0.2), classes) for _ in range(size)]
        both = list(dict.fromkeys(pop + young))
        keep = survivors(both, scored(both), size) if points is None else niche_survivors(scored(both), size, points, generation)
        pop = [both[i] for i in keep]
        best = frozenset(g for g, f in zip(pop, ranked(scored(pop)), strict=True) if f == 0)
        idle = idle + 1 if best == last else 0
        last = best
        state |= {"generation": generation + 1, "population": [list(g) for g in pop], "idle": idle, "best": sorted(map(list, best))}
    scores = scored(pop)
    return [(g, s) for g, s, f in zip(pop, scores, ranked(scores), strict=True) if f == 0]


def migrate(islands: dict[str, list[tuple[Genes, Scores]]], most: int = 2) -> dict[str, list[Genes]]:
    """What each island gets from the one before it in a ring, by name: its best few that the
    island doesn't have. An island without any of its own (an orphan) gets twice as many, from all."""
    names = sorted(islands)
    best = {n: [g for g, _ in sorted(islands[n], key=lambda x: (sum(x[1]), x[0]))] for n in names}
    out = {}
    for k, n in enumerate(names):
        own = set(best[n])
        donors = best[names[k - 1]] if own else [g for m in names for g in best[m][:most]]
        out[n] = [g for g in dict.fromkeys(donors) if g not in own][: most if own else 2 * most]
    return out


def evolve_islands(evaluate: Callable[[dict[str, list[Genes]]], dict[str, list[Scores]]], names: list[str], classes: list[int], weights: list[float], epochs: int = 3, generations: int = 2, size: int = 16, seed: int = 1, most: int = 2) -> dict[str, list[tuple[Genes, Scores]]]:
    """A population for each island, with an exchange of the best after each epoch. evaluate scores
    the genes of islands by name."""
    found: dict[str, list[tuple[Genes, Scores]]] = {n: [] for n in names}
    caches = {n: Cache() for n in names}
    incoming: dict[str, list[Genes]] = {n: [] for n in names}
    for epoch in range(epochs):
        for n in names:
            start = [*incoming[n], *(g for g, _ in found[n])]
            found[n] = evolve(lambda gs, n=n: evaluate({n: gs})[n], classes, weights, size, generations, seed=hash_seed(seed, epoch, n), cache=caches[n], seeds=start)
        incoming = migrate(found, most)
    return found


def hash_seed(*parts) -> int:
    import hashlib

    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def archive_pool(archive: list[tuple[Genes, Scores]], admit: Callable[[list[Genes]], list[bool]], most: int) -> list[Genes]:
    """Archive entries as a pool of rules: each genotype once, its best score, those that a fresh
    evaluation admits, best first."""
    best: dict[Genes, Scores] = {}
    for g, s in archive:
        if g not in best or s < best[g]:
            best[g] = s
    order = sorted(best, key=lambda g: (sum(best[g]), g))
    return [g for g, ok in zip(order, admit(order), strict=True) if ok][:most]


def search_trials(space: dict[str, list], score: Callable[[list[dict]], list[float]], trials: int, seed: int = 1, batch: int = 8) -> list[tuple[float, dict]]:
    """Hyper-parameter search: distinct settings drawn by the seed, half of each batch near the
    best one so far (one parameter changed), scored a batch at a time. All trials, best first."""
    r = random.Random(seed)
    done: list[tuple[float, dict]] = []
    seen: set[tuple] = set()
    limit = 1
    for values in space.values():
        limit *= len(values)
    while len(seen) < min(trials, limit):
        new: list[dict] = []
        tries = 0
        while len(new) < min(batch, trials - len(done)) and len(seen) < limit:
            if done and len(new) % 2 and tries < 50:
                x = dict(max(done, key=lambda t: t[0])[1])
                k = r.choice(sorted(space))
                x[k] = r.choice(space[k])
            else:
                x = {k: r.choice(v) for k, v in space.items()}
            tries += 1
            key = tuple(str(x[k]) for k in sorted(space))
            if key not in seen:
                seen.add(key)
                new.append(x)
        done += list(zip(score(new), new, strict=True))
    return sorted(done, key=lambda t: -t[0])


def balanced_score(valid: float, tail: float, gap_weight: float = 0.5) -> float:
    """Score of a trial: the mean of validation and tail, less a share of their gap."""
    return (valid + tail) / 2 - gap_weight * abs(valid - tail)


def compose_team(candidates: list, gain: Callable[[list], float], most: int = 20, beam: int = 3) -> list:
    """Greedy choice with a beam: add the candidate with the best gain while it grows."""
    beams: list[tuple[float, list]] = [(gain([]), [])]
    best = beams[0]
    for _ in range(most):
        grown = [(gain([*team, c]), [*team, c]) for _, team in beams for c in candidates if c not in team]
        beams = sorted(grown, key=lambda x: -x[0])[:beam]
        if not beams or beams[0][0] <= best[0]:
            break
        best = beams[0]
    return best[1]


def farthest_subset(points: list[Genes], n: int) -> list[Genes]:
    """Greedy max-min subset by Hamming distance."""
    out = points[:1]
    while len(out) < min(n, len(points)):
        far = lambda p: min(sum(x != y for x, y in zip(p, q, strict=True)) for q in out)
        out.append(max((p for p in points if p not in out), key=far))
    return out

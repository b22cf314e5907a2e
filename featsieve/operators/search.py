"""Population search over feature masks: genetic and particle-swarm rankers.

The driver holds masks only; a search is a state that proposes masks for a round and takes their fitness back. All masks
of a round are fitted and scored together by BatchLogistic, so the number of passes does not grow with the population.
Random draws are functions of (seed, round, individual): no draw depends on how many were made before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .batch_logistic import BatchLogistic, Problem, packed, weighted_f1
from .linear import class_count, logistic_input, scores_frame
from .split import stratified_folds

# fixed values: sizes of the search, and the constants of both methods
POOL, POPULATION, ROUNDS = 30, 20, 10
MUTATION = 0.05
INERTIA, PULL = 0.7, 1.4
SIZE_PENALTY, WINNER_BONUS, POOL_TRACE = 0.01, 100.0, 0.001

PARTS = 40  # stratified parts a round's validation quarter is drawn from
MAX_ROUNDS = 63  # a row's rounds are bits of a signed 64-bit number


class SubsetFitness:
    """Weighted F1 on a stratified quarter of the rows, minus a small charge for the share of features used."""

    def __init__(self, df: DataFrame, label: str, key: str, features: Sequence[str], rounds: int, seed: int):
        if rounds > MAX_ROUNDS:
            raise ValueError(f"at most {MAX_ROUNDS} rounds can be searched, not {rounds}")
        parted = stratified_folds(df.select(key, label, *features), label, key, PARTS, seed, "_part")
        bits = np.zeros(PARTS, dtype=np.int64)
        for r in range(rounds):
            train = np.random.default_rng(seed + r).permutation(PARTS)[PARTS // 4:]
            bits[train] |= np.int64(1) << r
        member = F.element_at(F.array(*[F.lit(int(b)) for b in bits]), F.col("_part"))
        self.data = packed(logistic_input(parted, label, features, member), len(features)).persist()
        self.batch = BatchLogistic(self.data, class_count(df, label), len(features))
        self.p = len(features)

    def score(self, masks: Sequence[np.ndarray], round_: int) -> np.ndarray:
        out = np.zeros(len(masks))
        distinct = {tuple(np.flatnonzero(m).tolist()) for m in masks} - {()}
        problems = [Problem(f, round_) for f in sorted(distinct)]
        if problems:
            found = self.batch.confusion(problems, self.batch.fit(problems, tol=1e-3))
            by_mask = {q.features: weighted_f1(c) - SIZE_PENALTY * len(q.features) / self.p for q, c in zip(problems, found)}
            for i, m in enumerate(masks):
                out[i] = by_mask.get(tuple(np.flatnonzero(m).tolist()), 0.0)
        return out

    def close(self) -> None:
        self.data.unpersist()


@dataclass
class Breeding:
    """Genetic search: binary tournaments pick parents, uniform crossover mixes them, bits flip rarely, the best one lives on."""

    n_bits: int
    size: int
    seed: int
    masks: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.masks = np.stack([self._draw(0, i).random(self.n_bits) < 0.5 for i in range(self.size)])

    def _draw(self, round_: int, individual: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, 1, round_, individual])

    def move(self, fitness: np.ndarray, round_: int) -> None:
        next_ = [self.masks[int(fitness.argmax())]]
        for child in range(1, self.size):
            draw = self._draw(round_ + 1, child)
            rivals = draw.integers(self.size, size=(2, 2))
            mother, father = (self.masks[pair[int(fitness[pair].argmax())]] for pair in rivals)
            mixed = np.where(draw.random(self.n_bits) < 0.5, mother, father)
            next_.append(mixed ^ (draw.random(self.n_bits) < MUTATION))
        self.masks = np.stack(next_)


@dataclass
class Swarm:
    """Binary particle swarm (Kennedy and Eberhart, 1997): a particle's speed is the log-odds of each bit."""

    n_bits: int
    size: int
    seed: int
    masks: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.speed = np.stack([self._draw(0, i).normal(0.0, 1.0, self.n_bits) for i in range(self.size)])
        self.masks = self._sample(0)
        self.own, self.own_fitness = self.masks.copy(), np.full(self.size, -np.inf)

    def _draw(self, round_: int, particle: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, 2, round_, particle])

    def _sample(self, round_: int) -> np.ndarray:
        chance = 1.0 / (1.0 + np.exp(-self.speed))
        return np.stack([np.random.default_rng([self.seed, 3, round_, i]).random(self.n_bits) < chance[i] for i in range(self.size)])

    def move(self, fitness: np.ndarray, round_: int) -> None:
        improved = fitness > self.own_fitness
        self.own = np.where(improved[:, None], self.masks, self.own)
        self.own_fitness = np.maximum(fitness, self.own_fitness)
        leader = self.own[int(self.own_fitness.argmax())].astype(float)
        for i in range(self.size):
            toward_own, toward_leader = self._draw(round_ + 1, i).random((2, self.n_bits))
            here = self.masks[i].astype(float)
            self.speed[i] = INERTIA * self.speed[i] + PULL * (toward_own * (self.own[i] - here) + toward_leader * (leader - here))
        self.masks = self._sample(round_ + 1)


def _search(
    kind: type, df: DataFrame, label: str, key: str, features: Sequence[str], relevance: DataFrame, seed: int, pool_size: int, size: int, rounds: int
) -> DataFrame:
    """Scores: how often a pool member was in a proposed mask, a bonus for the best mask's members, and its relevance.

    Features outside the pool, the most relevant ones, keep a trace of their relevance.
    """
    known = np.zeros(len(features))
    for r in relevance.collect():  # one number per feature
        known[r["pos"]] = r["score"]
    pool = np.lexsort((-np.arange(len(known)), -np.round(known, 12)))[:pool_size]
    fitness = SubsetFitness(df, label, key, [features[i] for i in pool], rounds, seed)
    state, chosen, top, winner = kind(len(pool), size, seed), np.zeros(len(pool)), -np.inf, np.zeros(len(pool), bool)
    for round_ in range(rounds):
        found = fitness.score(state.masks, round_)
        chosen += state.masks.sum(axis=0)
        if found.max() > top:
            top, winner = found.max(), state.masks[int(found.argmax())].copy()
        state.move(found, round_)
    fitness.close()
    scores = POOL_TRACE * known
    scores[pool] += chosen + WINNER_BONUS * winner + known[pool]
    return scores_frame(df, scores)


def genetic_scores(
    df: DataFrame, label: str, key: str, features: Sequence[str], relevance: DataFrame, seed: int = 42,
    pool_size: int = POOL, population: int = POPULATION, generations: int = ROUNDS,
) -> DataFrame:
    return _search(Breeding, df, label, key, features, relevance, seed, pool_size, population, generations)


def swarm_scores(
    df: DataFrame, label: str, key: str, features: Sequence[str], relevance: DataFrame, seed: int = 42,
    pool_size: int = POOL, particles: int = POPULATION, iterations: int = ROUNDS,
) -> DataFrame:
    return _search(Swarm, df, label, key, features, relevance, seed, pool_size, particles, iterations)

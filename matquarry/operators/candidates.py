"""Candidate compositions: enumeration, neighbours, mutation, sampling and chains.

The constraint space is enumerated instead of drawn: it is small, every candidate
gets an exact score, and a sample is the head of a hash order, uniform and the same in
every run.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as fx

Groups = dict[str, tuple[tuple[str, ...], int, int]]
#: Log weights of a matrix of counts.
Score = Callable[[np.ndarray], np.ndarray]

#: Default element groups with the least and largest count of each.
DEFAULT_GROUPS: Groups = {
    "A": (("Ag", "Cu", "In", "Sn", "Pb"), 2, 10),
    "B": (("As", "Sb", "Ge", "Bi", "Ti", "V"), 1, 10),
    "Ch": (("S", "Se", "Te"), 1, 10),
}
MAX_ATOMS = 20

#: Substitutes of an element within its family.
SUBSTITUTES = {
    "S": ("Se", "Te"), "Se": ("S", "Te"), "Te": ("S", "Se"), "Ag": ("Cu",), "Cu": ("Ag",), "Ge": ("Sn", "Pb"), "Sn": ("Ge", "Pb"),
    "Pb": ("Ge", "Sn"), "As": ("Sb", "Bi"), "Sb": ("As", "Bi"), "Bi": ("As", "Sb"), "Ti": ("V",), "V": ("Ti",),
}


def candidate_space(spark: SparkSession, groups: Groups = DEFAULT_GROUPS, max_atoms: int = MAX_ATOMS) -> DataFrame:
    """(formula, composition): every valid composition, one element a group.

    The product is of parameters, never of data; counts that exceed the total are cut
    before elements multiply them."""
    names = list(groups)
    counts = spark.range(1)
    for name in names:
        _, least, most = groups[name]
        counts = counts.withColumn(f"n_{name}", F.explode(F.sequence(F.lit(least), F.lit(most))))
    counts = counts.where(sum((F.col(f"n_{n}") for n in names), F.lit(0)) <= max_atoms)
    for name in names:
        counts = counts.withColumn(f"e_{name}", F.explode(F.array(*map(F.lit, groups[name][0]))))
    entries = F.array_sort(F.array(*(F.struct(F.col(f"e_{n}").alias("element"), F.col(f"n_{n}").cast("double").alias("amount")) for n in names)))
    return counts.select(F.map_from_entries(entries).alias("composition")).select(
        fx.composition_to_formula(F.col("composition")).alias("formula"), "composition"
    )


def _replaced(composition: Column, old: Column, new: Column) -> Column:
    return F.map_from_entries(
        F.array_sort(
            F.transform(
                F.map_entries(composition),
                lambda e: F.struct(F.when(e["key"] == old, new).otherwise(e["key"]).alias("key"), e["value"].alias("value")),
            )
        )
    )


def _stepped(composition: Column, element: Column, step: Column) -> Column:
    return F.transform_values(composition, lambda k, v: v + F.when(k == element, step).otherwise(F.lit(0.0)))


def neighbours(candidates: DataFrame, groups: Groups = DEFAULT_GROUPS, max_atoms: int = MAX_ATOMS) -> DataFrame:
    """(formula, move, neighbour, neighbour_composition): every valid composition one step away.

    A step changes one element for another of its group, or one count by 1. Needs
    columns formula and composition; compositions without valid moves give no rows."""
    partner = {e: [x for x in members if x != e] for members, _, _ in groups.values() for e in members}
    pairs = F.create_map(*itertools.chain.from_iterable((F.lit(e), F.array(*map(F.lit, p))) for e, p in partner.items() if p))
    return _moved(candidates, pairs).where(fx.is_valid_composition(F.col("neighbour_composition"), groups, max_atoms))


def _moved(candidates: DataFrame, pairs: Column) -> DataFrame:
    each = candidates.select("formula", "composition", F.explode(F.map_keys("composition")).alias("element"))
    swapped = each.select(
        "formula", F.lit("substitute").alias("move"), "composition", "element", F.explode(F.element_at(pairs, F.col("element"))).alias("new")
    ).where(~F.array_contains(F.map_keys("composition"), F.col("new"))).select("formula", "move", _replaced(F.col("composition"), F.col("element"), F.col("new")).alias("neighbour_composition"))
    stepped = each.select("formula", "composition", "element", F.explode(F.array(F.lit(-1.0), F.lit(1.0))).alias("step")).select(
        "formula", F.lit("count").alias("move"), _stepped(F.col("composition"), F.col("element"), F.col("step")).alias("neighbour_composition")
    )
    both = swapped.unionByName(stepped).where(F.forall(F.map_values("neighbour_composition"), lambda v: v >= 1))
    return both.select(
        "formula", "move", fx.composition_to_formula(F.col("neighbour_composition")).alias("neighbour"), "neighbour_composition"
    )


def mutations(winners: DataFrame, max_atoms: int = MAX_ATOMS) -> DataFrame:
    """(formula, composition): new compositions one same-family substitution or one count away from ``winners``.

    Winners themselves and totals above ``max_atoms`` are left out; each formula comes once."""
    pairs = F.create_map(*itertools.chain.from_iterable((F.lit(e), F.array(*map(F.lit, p))) for e, p in SUBSTITUTES.items()))
    moved = _moved(winners, pairs).where(
        (fx.total_atoms(F.col("neighbour_composition")) <= max_atoms)
        & (F.size("neighbour_composition") > 0)
    )
    new = moved.select(F.col("neighbour").alias("formula"), F.col("neighbour_composition").alias("composition"))
    return new.dropDuplicates(["formula"]).join(winners.select("formula").distinct(), "formula", "left_anti")


def hash_sample(candidates: DataFrame, n: int, seed: int = 42, key: str = "formula") -> DataFrame:
    """The n rows of the least hash of (seed, key): a uniform sample without repeats, equal in every run."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))
    return candidates.orderBy(order, key).limit(n)


def mixed_candidates(space: DataFrame, winners: DataFrame, n: int, mutation_share: float = 0.7, seed: int = 42) -> DataFrame:
    """(formula, composition, origin): n candidates, ``mutation_share`` of them mutated winners, the rest random.

    Fewer mutations than asked for are made up by random ones; without winners all are random."""
    mutated = hash_sample(mutations(winners), int(n * mutation_share), seed).select("formula", "composition", F.lit("mutation").alias("origin"))
    # a mutation may also be in the space; random picks leave winners and mutations out
    taken = mutated.select("formula").union(winners.select("formula"))
    drawn = hash_sample(space.join(taken, "formula", "left_anti"), n, seed).select("formula", "composition", F.lit("random").alias("origin"))
    every = mutated.unionByName(drawn)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "formula"))
    return every.orderBy(F.col("origin"), order, "formula").limit(n)


def uniform(chain: np.ndarray, step: int, draw: int) -> np.ndarray:
    """A number in [0, 1) for each chain's step and draw: a hash, so that a chain is the same wherever and beside whichever others it runs."""
    x = np.asarray(chain, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 0xD1B54A32D192ED03 + draw + 1) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


class Chains:
    """Compositions of several chains, one element and count a group, moved together."""

    def __init__(self, ids: np.ndarray, score: Score, groups: Groups, max_atoms: int) -> None:
        self.ids, self.score, self.max_atoms = ids, score, max_atoms
        self.members = [m for m, _, _ in groups.values()]
        self.sizes = np.array([len(m) for m in self.members])
        self.least, self.most = np.array([max(1, a) for _, a, _ in groups.values()]), np.array([b for _, _, b in groups.values()])
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        if self.least.sum() > max_atoms or (self.least > self.most).any():
            raise ValueError("no composition meets the bounds")
        n, g = len(ids), len(self.members)
        self.element = np.column_stack([np.floor(uniform(ids, 0, i) * self.sizes[i]) for i in range(g)]).astype(int).reshape(n, g)
        self.count = np.tile(self.least, (n, 1))
        for i in range(g):  # each group's count from what the least of the others leaves
            room = np.minimum(self.most[i], max_atoms - (self.count.sum(1) - self.count[:, i]))
            self.count[:, i] += np.floor(uniform(ids, 0, g + i) * (room - self.least[i] + 1)).astype(int)
        self.weight = self.scored(self.element, self.count)
        self.accepted = np.zeros(n, int)

    def scored(self, element: np.ndarray, count: np.ndarray) -> np.ndarray:
        table = np.zeros((len(element), self.offsets[-1]))
        for i, offset in enumerate(self.offsets[:-1]):
            table[np.arange(len(element)), offset + element[:, i]] = count[:, i]
        return np.asarray(self.score(table), float)

    def move(self, live: np.ndarray, step: int, swap_share: float, temperature: float) -> None:
        """One step of the chains numbered ``live``: a proposal each, all scored in one call."""
        ids, rows = self.ids[live], np.arange(len(live))
        element, count = self.element[live], self.count[live]
        group = np.floor(uniform(ids, step, 0) * len(self.members)).astype(int)
        swaps = uniform(ids, step, 1) < swap_share
        others = self.sizes[group] - 1
        other = np.floor(uniform(ids, step, 2) * others).astype(int)
        own = element[rows, group]
        element[rows, group] = np.where(swaps & (others > 0), other + (other >= own), own)
        count[rows, group] += np.where(swaps, 0, np.where(uniform(ids, step, 3) < 0.5, 1, -1))
        changed = count[rows, group]
        valid = (changed >= self.least[group]) & (changed <= self.most[group]) & (count.sum(1) <= self.max_atoms)
        weight = np.full(len(live), -np.inf)
        if valid.any():
            weight[valid] = self.scored(element[valid], count[valid])
        with np.errstate(divide="ignore", invalid="ignore"):
            passes = valid & (np.log(uniform(ids, step, 4)) < (weight - self.weight[live]) / temperature)
        taken = live[passes]
        self.element[taken], self.count[taken], self.weight[taken] = element[passes], count[passes], weight[passes]
        self.accepted[taken] += 1

    def formula(self, i: int) -> str:
        parts = sorted((self.members[g][e], c) for g, (e, c) in enumerate(zip(self.element[i], self.count[i])))
        return "".join(f"{e}{c if c != 1 else ''}" for e, c in parts)


def metropolis_chains(
    seeds: DataFrame, score: Score, n_samples: int, groups: Groups = DEFAULT_GROUPS, burn_in: int = 200, thin: int = 5, swap_share: float = 0.4, temperature: float = 1.0,
    max_atoms: int = MAX_ATOMS,
) -> DataFrame:
    """(chain, formula, weight, step, acceptance): Metropolis-Hastings samples, one independent chain a row of ``seeds``, (chain long).

    ``score`` takes a matrix of counts, a row a composition and a column an element in the order of ``groups``, and returns log weights. The
    chains of a batch move in lock step, and all proposals of a step are scored in one call, so the space itself is never made and may be of any size.
    A step swaps the element of one group or changes its count by one; proposals out of bounds are rejected. A chain keeps each formula once, at
    most ``n_samples`` of them, and gives up after ten times the steps that takes. Null chains and an empty table give no rows."""
    longest = burn_in + thin * n_samples * 10

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            chains = Chains(frame["chain"].to_numpy(np.int64), score, groups, max_atoms)
            n = len(frame)
            seen: list[dict[str, tuple[float, int]]] = [{} for _ in range(n)]
            steps, live, step = np.zeros(n, int), np.arange(n), 0
            while len(live) and step < longest and n_samples:
                step += 1
                chains.move(live, step, swap_share, temperature)
                steps[live] = step
                if step > burn_in and step % thin == 0:
                    for i in live:
                        seen[i].setdefault(chains.formula(i), (float(chains.weight[i]), step))
                    live = np.array([i for i in live if len(seen[i]) < n_samples], int)
            rate = chains.accepted / np.maximum(steps, 1)
            kept = [(c, f, w, s, a) for c, own, a in zip(chains.ids, seen, rate) for f, (w, s) in own.items()]
            yield pd.DataFrame(kept, columns=["chain", "formula", "weight", "step", "acceptance"])

    return seeds.where("chain IS NOT NULL").select(F.col("chain").cast("long")).mapInPandas(run, "chain long, formula string, weight double, step int, acceptance double")

"""Guided tree search over the code graph, one group of rows for each query.

Neighbours, similarities and scores are joined before; the search itself walks in memory, and returns ranked nodes or its trace.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..providers import Provider


@dataclass
class Node:
    """A tree node: counters of its own visits and of rewards its children brought."""

    id: str
    label: str
    similarity: float
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    visits: int = 0
    total: float = 0.0
    simulated: float = 0.0
    simulations: int = 0
    expanded: bool = False
    closed: bool = False  # nothing below can be expanded any more, which stays so
    open: list[Node] = field(default_factory=list)  # children not known to be closed

    @property
    def mean(self) -> float:
        return self.total / self.visits if self.visits else 0.0


@dataclass(frozen=True)
class Settings:
    """iterations; children at once and their least number; weights; ``references`` also follows users and used nodes above a
    similarity; ``last_wins`` picks the last child that can be expanded instead of the best one."""

    iterations: int = 200
    k: int = 15
    k_least: int = 20
    alpha: float = 0.5
    exploration: float = 0.1
    references: bool = False
    reference_similarity: float = 0.75
    reference_most: int = 10
    last_wins: bool = False
    results: int = 10


class Search:
    def __init__(self, root: str, labels: dict[str, str], near: dict[str, list[str]], similarity: dict[str, float], reward: dict[str, float], size: int, settings: Settings, uses: dict[str, list[str]] | None = None, scorer: Callable[[list[str]], list[float]] | None = None):
        self.scorer = scorer  # scores nodes when they are first reached; without it all rewards are given
        self.labels, self.near, self.similarity, self.reward, self.size, self.s, self.uses = labels, near, similarity, reward, size, settings, uses or {}
        self.root = Node(root, labels.get(root, "Repo"), similarity.get(root, 0.0))
        self.known = {root}
        self.k = settings.k
        self.trace: list[tuple[int, str, int, float]] = []

    def can_expand(self, n: Node) -> bool:
        if not n.expanded:  # what is known stays known, so a node without new neighbours has none later
            n.expanded = not any(c not in self.known and self.similarity.get(c, 0.0) > 0 for c in self.near.get(n.id, ()))
        return not n.expanded

    def open_below(self, n: Node) -> bool:
        """Whether anything below can be expanded; each node is closed once, so over a search this is linear in the tree."""
        way = [n]
        while way:
            x = way[-1]
            if not x.closed and self.can_expand(x):
                return True
            while x.open and x.open[-1].closed:
                x.open.pop()
            if x.closed or not x.open:
                x.closed = True
                way.pop()
            else:
                way.append(x.open[-1])
        return False

    def select(self) -> Node | None:
        """Down from the root to a node that can be expanded: an unvisited child of best similarity, else the best upper bound."""
        n = self.root
        if not self.open_below(n):
            return None
        while not self.can_expand(n):
            choices = [c for c in n.children if self.open_below(c)]
            fresh = [c for c in choices if not c.visits]
            if fresh:
                n = max(fresh, key=lambda c: (c.similarity, c.id))
            elif self.s.last_wins:
                n = choices[-1]
            else:
                bound = lambda c: c.mean + self.s.exploration * math.sqrt(2 * math.log(max(1, n.visits)) / c.visits)  # noqa: E731, B023
                n = max(choices, key=lambda c: (bound(c), c.id))
        return n

    def add(self, parent: Node, ids: list[str]) -> list[Node]:
        made = []
        for i in ids:
            if i not in self.known:
                self.known.add(i)
                made.append(Node(i, self.labels.get(i, ""), self.similarity.get(i, 0.0), parent))
        parent.children += made
        parent.open += made
        return made

    def expand(self, n: Node) -> list[Node]:
        """The k most similar neighbours that are new; the rest waits until the node is expanded again.  After the root's first
        expansion k is halved, but not below its least number."""
        fresh = [c for c in self.near.get(n.id, ()) if c not in self.known and self.similarity.get(c, 0.0) > 0]
        made = self.add(n, sorted(fresh, key=lambda c: (-self.similarity[c], c))[: self.k])
        n.expanded = len(fresh) <= self.k
        if n is self.root and self.k == self.s.k:
            self.k = max(self.s.k_least, self.k // 2)
        if self.s.references and n is not self.root:
            linked = [c for c in self.uses.get(n.id, ()) if self.similarity.get(c, 0.0) > self.s.reference_similarity]
            made += self.add(n, sorted(linked, key=lambda c: (-self.similarity[c], c))[: self.s.reference_most])
        return made

    def learn(self, nodes: list[Node]) -> None:
        if self.scorer and (asked := [x.id for x in nodes if x.id not in self.reward]):
            self.reward.update(zip(asked, self.scorer(asked)))
        for x in nodes:
            value = self.reward.get(x.id, 0.0)
            x.visits += 1
            x.total += value
            p = x.parent
            while p is not None:
                p.visits += 1
                p.total += value
                p.simulated += value
                p.simulations += 1
                p = p.parent

    def run(self) -> list[tuple[str, float, int]]:
        for turn in range(self.s.iterations):
            if len(self.known) >= self.size:
                break
            n = self.select()
            if n is None:
                break
            self.trace.append((turn, n.id, n.visits, n.total))
            self.learn(self.expand(n))
        return self.best()

    def count(self) -> int:
        return len(self.known)

    def best(self) -> list[tuple[str, float, int]]:
        """Visited nodes by their blended score, in breadth-first order where equal; no modules, no repository."""
        found, queue = [], deque([self.root])
        while queue:
            n = queue.popleft()
            queue.extend(n.children)
            if n.visits and n.label not in ("Module", "Repo"):
                found.append((n.id, self.s.alpha * n.mean + (1 - self.s.alpha) * 10 * n.similarity, n.visits))
        return sorted(found, key=lambda x: -x[1])[: self.s.results]


def _search_of(pdf: pd.DataFrame, settings: Settings, provider: Provider | None = None) -> Search:
    near: dict[str, list[str]] = {}
    uses: dict[str, list[str]] = {}
    labels, similarity, reward, root = {}, {}, {}, None
    texts: dict[str, str] = {}
    for r in pdf.sort_values("node_id").itertuples(index=False):
        labels[r.node_id], similarity[r.node_id] = r.label, r.similarity
        if provider:
            texts[r.node_id] = r.text or ""
        else:
            reward[r.node_id] = r.reward
        near[r.node_id] = sorted(r.children) if r.children is not None else []
        uses[r.node_id] = sorted(r.users) if r.users is not None else []
        if r.label == "Repo":
            root = r.node_id

    def scored(ids: list[str]) -> list[float]:
        question = pdf["question"].iloc[0] or ""
        return [min(max(10.0 * float(x), 0.0), 10.0) for x in provider.score([(question, texts[i]) for i in ids])]

    return Search(root or min(labels), labels, near, similarity, reward, int(pdf["size"].iloc[0]), settings, uses, scored if provider else None)


def search(space: DataFrame, settings: Settings | None = None, per: str = "query_id", provider: Provider | None = None) -> DataFrame:
    """(query_id, node_id, score, visits, rank) of each query's best nodes.

    space(query_id, node_id, label, children, users, similarity, reward, size): a row for each node of the query's repository;
    one repository must fit in a task, which is why code and vectors are not in it.  With a ``provider`` the columns question and text stand
    in place of reward, and it scores the nodes as they are reached, a batch for an expansion."""
    s = settings or Settings()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _search_of(pdf, s, provider).run()
        return pd.DataFrame([(pdf[per].iloc[0], i, round(score, 9), v, at + 1) for at, (i, score, v) in enumerate(found)], columns=[per, "node_id", "score", "visits", "rank"])

    return space.groupBy(per).applyInPandas(run, f"{per} string, node_id string, score double, visits int, rank int")


def traces(space: DataFrame, settings: Settings | None = None, per: str = "query_id") -> DataFrame:
    """(query_id, nodes, selected): the tree's size and the node selected in each iteration, with its counters then."""
    s = settings or Settings()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _search_of(pdf, s)
        x.run()
        rows = [{"iteration": t, "node_id": i, "visits": v, "total": total} for t, i, v, total in x.trace]
        return pd.DataFrame([(pdf[per].iloc[0], x.count(), rows)], columns=[per, "nodes", "selected"])

    return space.groupBy(per).applyInPandas(run, f"{per} string, nodes int, selected array<struct<iteration int, node_id string, visits int, total double>>")


def space_of(nodes: DataFrame, children: DataFrame, similarity: DataFrame, sizes: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The search space: nodes(repo, node_id, label) with children(node_id, child), similarity(query_id, repo, node_id, similarity,
    reward), sizes(repo, size)."""
    kids = children.groupBy("node_id").agg(F.collect_set("child").alias("children"))
    both = users.groupBy("node_id").agg(F.collect_set("child").alias("users")) if users is not None else None
    out = similarity.join(nodes.select("node_id", "label"), "node_id").join(kids, "node_id", "left").join(sizes, "repo")
    out = out.join(both, "node_id", "left") if both is not None else out.withColumn("users", F.lit(None).cast("array<string>"))
    return out.select("query_id", "node_id", "label", "children", "users", "similarity", "reward", "size")


__all__ = ["Node", "Search", "Settings", "search", "space_of", "traces"]

"""Fill containers of fixed capacity with little unused space.

Items of one size are interchangeable, so packing needs only how many there are of each
size: at most ``capacity`` numbers, whatever the corpus holds.  Bin completion branches over
containers: the next container is built around the largest remaining item, and each
undominated filling around it is a branch, fullest first.  A filling is dominated if an
item left out fits in place of some of its items that together are no larger.  A branch
ends when the unused space so far exceeds what a better packing may waste in all, or when
its remaining sizes were searched before with no more waste.  The incumbents are best-fit
packings: fillings of least waste around the largest size, repeated as often as the counts
allow, and best fit decreasing.  The search stops when the incumbent needs no more containers
than a lower bound.  Search nodes are counted; if they run out the plan says so, with its
bound, and the incumbent stands.

The plan (fillings with multiplicities) is broadcast; every item finds its container from
its rank among the items of its size.  Ranks are taken over range partitions, so no size,
however common, is gathered in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.tokens import DEFAULT_TOKENIZER, token_count
from roadweave.runtime import Scratch, grouped_rank, ship

#: Search nodes of one branch and bound; what they don't settle is reported as a gap to the bound.
NODE_BUDGET = 20_000


def complete(room: int, counts: dict[int, int], sizes: list[int], budget: int = NODE_BUDGET) -> list[tuple[int, int]]:
    """The filling of ``room`` that wastes least, as (size, number) pairs, largest size first.

    ``sizes`` is sorted downwards.  A filling is dominated, and skipped, if a larger single
    item that is still there fits in place of one it has; branching on the number of each
    size from the most that fit downwards visits the dominating fillings first, and a branch
    ends as soon as what it leaves can't be less than the incumbent's waste.
    """
    fit = [s for s in sizes if s <= room and counts[s] > 0]
    best: list = []
    left = room
    for s in fit:  # best fit: as much of the largest as goes in
        k = min(counts[s], left // s)
        if k:
            best.append((s, k))
            left -= k * s
    waste = left
    if not waste or not fit:
        return best
    rest = [0] * (len(fit) + 1)  # all that the sizes from i on could fill
    for i in range(len(fit) - 1, -1, -1):
        rest[i] = min(room, rest[i + 1] + fit[i] * counts[fit[i]])
    smallest = fit[-1]
    seen: set[tuple[int, int]] = set()
    stack = [(0, room, ())]
    while stack and budget:
        budget -= 1
        i, free, taken = stack.pop()
        if free < waste:
            best, waste = list(taken), free
            if not waste:
                break
        while i < len(fit) and fit[i] > free:
            i += 1
        if i == len(fit) or free < smallest or free - rest[i] >= waste or (i, free) in seen:
            continue
        seen.add((i, free))
        s = fit[i]
        for k in range(min(counts[s], free // s) + 1):  # the stack turns this round: most first
            stack.append((i + 1, free - k * s, taken + ((s, k),) if k else taken))
    return best


Filling = list[tuple[int, int]]


@dataclass
class Plan:
    """Fillings with their multiplicities, the least conceivable number of containers, and what the search did."""

    fillings: list[tuple[int, Filling]] = field(default_factory=list)
    bound: int = 0
    nodes: int = 0
    complete: bool = True

    @property
    def containers(self) -> int:
        return sum(times for times, _ in self.fillings)

    @property
    def proven(self) -> bool:
        """Whether no packing has fewer containers: the bound is met or the search was complete."""
        return self.containers == self.bound or self.complete


def least_containers(counts: dict[int, int], capacity: int) -> int:
    """A number of containers that no packing can go below.

    For every threshold t: items over capacity - t need a container each that takes none of
    the items from t on, items over half the capacity need one each, and the rest from t on
    fills at best what those leave.
    """
    sizes = sorted(counts)
    best = max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    for t in [s for s in sizes if 2 * s <= capacity]:
        alone = sum(n for s, n in counts.items() if s > capacity - t)
        large = {s: n for s, n in counts.items() if capacity - t >= s and 2 * s > capacity}
        free = capacity * sum(large.values()) - sum(s * n for s, n in large.items())
        small = sum(s * n for s, n in counts.items() if t <= s and 2 * s <= capacity)
        best = max(best, alone + sum(large.values()) + max(0, -(-(small - free) // capacity)))
    return best


def _repeated(counts: dict[int, int], capacity: int, budget: int) -> list[tuple[int, Filling]]:
    """A packing of least-waste fillings around the largest size, each repeated while the counts allow."""
    left = dict(counts)
    plan = []
    sizes = sorted(left, reverse=True)
    while sizes:
        top = sizes[0]
        left[top] -= 1
        tail = complete(capacity - top, left, sizes, budget)
        left[top] += 1
        filling: dict[int, int] = {top: 1}
        for s, k in tail:
            filling[s] = filling.get(s, 0) + k
        times = min(left[s] // k for s, k in filling.items())
        for s, k in filling.items():
            left[s] -= times * k
        plan.append((times, sorted(filling.items(), reverse=True)))
        sizes = [s for s in sizes if left[s]]
    return plan


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Best fit decreasing, for all containers of one room at once, so the number of items doesn't matter.

    The tightest container takes items of a size until none fits, which is what best fit does
    item by item.
    """
    rooms: list[int] = []  # the rooms that some container has, upwards
    inside: dict[int, list[tuple[int, Filling]]] = {}

    def put(room: int, times: int, filling: Filling) -> None:
        if room not in inside:
            insort(rooms, room)
        inside.setdefault(room, []).append((times, filling))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(rooms, s)
            room = rooms[at] if at < len(rooms) else capacity
            times, filling = inside[room].pop() if at < len(rooms) else (n, [])
            if at < len(rooms) and not inside[room]:
                del inside[room], rooms[at]
            k = min(n, room // s)
            some = min(times, n // k)
            if times > some and filling:
                put(room, times - some, filling)
            put(room - k * s, some, [*filling, (s, k)])
            n -= some * k
    return [x for room in rooms for x in inside[room]]


def _dominated(taken: list[int], free: int, out: list[int]) -> bool:
    """Whether an item left out fits in place of some taken ones that together are no larger."""
    sums = {0}
    for x in taken:
        sums |= {y + x for y in sums}
    at = sorted(sums)
    for s in out:  # a sum with sum <= s <= sum + free, other than the item itself
        k = bisect_left(at, s - free)
        if k < len(at) and at[k] <= s and (at[k] < s or s not in taken):
            return True
    return False


def _fillings(room: int, left: dict[int, int], sizes: list[int], most_waste: int) -> Iterator[tuple[int, list[int] | None]]:
    """(waste, items) of the undominated fillings of ``room`` that waste at most ``most_waste``, fullest first.

    A dominated filling comes as None, so that looking at it is counted.

    The sums that the sizes from i on can make are bits of a number, so only combinations
    that do reach the wanted sum are walked.
    """
    fit = [s for s in sizes if s <= room and left[s] > 0]
    mask = (1 << (room + 1)) - 1
    sums = [1] * (len(fit) + 1)
    for i in range(len(fit) - 1, -1, -1):
        bits, s, n, step = sums[i + 1], fit[i], min(left[fit[i]], room // fit[i]), 1
        while n:  # n copies, by powers of two
            step = min(step, n)
            bits |= (bits << (s * step)) & mask
            n, step = n - step, step * 2
        sums[i] = bits

    def go(i: int, need: int, taken: list[int]) -> Iterator[list[int]]:
        if not need:
            yield taken
            return
        while i < len(fit) and fit[i] > need:
            i += 1
        if i == len(fit) or not sums[i] >> need & 1:
            return
        s = fit[i]
        for k in range(min(left[s], need // s), -1, -1):
            yield from go(i + 1, need - k * s, taken + [s] * k)

    for waste in range(min(most_waste, room) + 1):
        if sums[0] >> (room - waste) & 1:
            for taken in go(0, room - waste, []):
                ok = not waste or not _dominated(taken, waste, [s for s in fit if left[s] > taken.count(s)])
                yield waste, taken if ok else None


def _search(counts: dict[int, int], capacity: int, most: int, budget: int) -> tuple[list[Filling] | None, int, bool]:
    """(a packing into fewer than ``most`` containers or None, nodes, whether the search was complete)."""
    total = sum(s * n for s, n in counts.items())
    nodes, whole = 0, True
    left = {s: n for s, n in counts.items() if n}
    seen: dict[tuple, int] = {}
    # One entry a container: its largest item, the fillings still to try, the one in place, the waste allowed from here on.
    stack: list[list] = []
    allowed = (most - 1) * capacity - total
    if allowed < 0:
        return None, 0, True
    while True:
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        if not sizes:
            both = [[e[0], *e[2][1]] for e in stack]
            return [[(s, b.count(s)) for s in sorted(set(b), reverse=True)] for b in both], nodes, True
        state = tuple((s, left[s]) for s in sizes)
        if seen.get(state, -1) < allowed:
            seen[state] = allowed
            left[sizes[0]] -= 1
            stack.append([sizes[0], _fillings(capacity - sizes[0], left, sizes, allowed), None, allowed])
        while stack:  # the next filling of the last container that has one
            top, todo, placed, before = stack[-1]
            if placed:
                for x in placed[1]:
                    left[x] += 1
            stack[-1][2] = None
            nxt = (0, None)
            while nxt and nxt[1] is None:
                nodes += 1
                if nodes > budget:
                    return None, nodes, False
                nxt = next(todo, None)
            if nxt is None:
                left[top] += 1
                stack.pop()
                continue
            for x in nxt[1]:
                left[x] -= 1
            stack[-1][2], allowed = nxt, before - nxt[0]
            break
        else:
            return None, nodes, whole


#: Items of the least full containers that are searched together where the whole is too large for a tree.
TAIL_ITEMS = 200


def _singles(fillings: list[tuple[int, Filling]]) -> Iterator[Filling]:
    """Containers one by one, the least full first."""
    for times, f in sorted(fillings, key=lambda x: sum(s * k for s, k in x[1])):
        for _ in range(times):
            yield f


def _shorter(best: Plan, capacity: int, budget: int) -> bool:
    """Try to pack the least full containers, or all, into one container less; True if it was done."""
    tail, items = [], 0
    for f in _singles(best.fillings):
        items += sum(k for _, k in f)
        if items > TAIL_ITEMS and len(tail) > 1:
            break
        tail.append(f)
    counts: dict[int, int] = {}
    for f in tail:
        for s, k in f:
            counts[s] = counts.get(s, 0) + k
    found, nodes, whole = _search(counts, capacity, len(tail), budget)
    best.nodes += nodes
    if found is None:
        best.complete = whole and len(tail) == best.containers
        return False
    used: dict[tuple, int] = {}
    for f in tail:
        used[tuple(f)] = used.get(tuple(f), 0) + 1
    kept = []
    for times, f in best.fillings:
        gone = min(times, used.get(tuple(f), 0))
        used[tuple(f)] = used.get(tuple(f), 0) - gone
        if times > gone:
            kept.append((times - gone, f))
    best.fillings = kept + [(1, f) for f in found]
    return True


def plan(counts: dict[int, int], capacity: int, budget: int = NODE_BUDGET) -> Plan:
    """A packing that uses every item of ``counts`` exactly once, with its bound and whether it is proven least.

    Where the incumbent misses the bound, branch and bound looks for one container less, and
    again, until the bound is met, the tree is exhausted or the budget is spent.  More than
    TAIL_ITEMS items are searched among the least full containers only, which can't prove
    the whole.
    """
    have = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in have):
        raise ValueError("sizes must lie between 1 and the capacity")
    if not have:
        return Plan()
    best = Plan(_repeated(have, capacity, budget), least_containers(have, capacity), 0, False)
    if best.containers > best.bound:
        fit = _best_fit(have, capacity)
        best.fillings = fit if sum(t for t, _ in fit) < best.containers else best.fillings
    while best.containers > best.bound and best.nodes < budget and _shorter(best, capacity, budget - best.nodes):
        pass
    return best


def plan_containers(counts: dict[int, int], capacity: int, budget: int = NODE_BUDGET) -> list[tuple[int, Filling]]:
    """(multiplicity, filling) pairs that use every item of ``counts`` exactly once."""
    return plan(counts, capacity, budget).fillings


def pack(items: DataFrame, item_id: str, text: str, capacity: int, tokenizer: str = DEFAULT_TOKENIZER, budget: int = NODE_BUDGET) -> DataFrame:
    """Every text in a container: (container_id, item_id, piece, first_token, n_tokens).

    A text longer than ``capacity`` tokens is split into pieces of ``capacity`` tokens and a
    remainder; no other text is split.  ``first_token`` is where the piece starts in its
    text.  A text that is null, empty or has no token needs no space: it gets container_id
    null, piece 0 and n_tokens 0.  Repeated ids are separate items.  Containers are numbered
    from 0; the same items always get the same containers.  ``report`` tells how many
    containers no packing can go below.
    """
    return _pack(items, item_id, text, capacity, tokenizer, budget)[0]


def _pack(items: DataFrame, item_id: str, text: str, capacity: int, tokenizer: str, budget: int) -> tuple[DataFrame, Plan]:
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    ship(items.sparkSession)
    scratch = Scratch(items.sparkSession, "packing")
    sized = scratch.cut(items.select(F.col(item_id).alias("_id"), token_count(text, tokenizer).alias("_n")))
    starts = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1, F.lit(capacity))).otherwise(F.array(F.lit(0)))
    pieces = sized.select("_id", "_n", F.posexplode(starts).alias("piece", "first_token")).select(
        "_id", "piece", "first_token", F.least(F.col("_n") - F.col("first_token"), F.lit(capacity)).alias("n_tokens")
    )
    counts = {r["n_tokens"]: r["count"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}  # at most ``capacity`` rows
    rows, base, first = [], dict.fromkeys(counts, 0), 0
    filled = plan(counts, capacity, budget)
    for times, filling in filled.fillings:
        for size, k in filling:
            rows.append((size, base[size], base[size] + times * k, k, first))
            base[size] += times * k
        first += times
    table = items.sparkSession.createDataFrame(rows, "size int, lo bigint, hi bigint, each bigint, first bigint")
    ranked = grouped_rank(pieces, ["n_tokens"], ["_id", "piece"], "_rank", scratch, few_groups=True)
    placed = ranked.join(F.broadcast(table), (F.col("n_tokens") == F.col("size")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")), "left")
    container = F.col("first") + F.floor((F.col("_rank") - F.col("lo")) / F.col("each")).cast("bigint")
    return placed.select(container.alias("container_id"), F.col("_id").alias(item_id), "piece", "first_token", "n_tokens"), filled


def report(items: DataFrame, item_id: str, text: str, capacity: int, tokenizer: str = DEFAULT_TOKENIZER, budget: int = NODE_BUDGET) -> DataFrame:
    """One row on the result of ``pack``: containers, tokens, unused tokens, fullest container, and the plan's account.

    ``bound``: containers that no packing can go below; ``gap``: how many more were used;
    ``proven``: whether the result is known to be least; ``search_nodes``: what that took.
    """
    packed, filled = _pack(items, item_id, text, capacity, tokenizer, budget)
    account = [F.lit(filled.bound).cast("bigint").alias("bound"), F.lit(filled.containers - filled.bound).cast("bigint").alias("gap"), F.lit(filled.proven).alias("proven"), F.lit(filled.nodes).cast("bigint").alias("search_nodes")]
    return container_report(packed, capacity).select("*", *account)


def container_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, unused tokens, the least possible number of containers."""
    used = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(capacity - F.col("t")), F.lit(0)).alias("unused"), F.max("t").alias("fullest")
    ).withColumn("least_containers", F.ceil(F.col("tokens") / capacity))

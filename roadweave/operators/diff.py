"""Differences between two copies of a dataset, row by row and field by field.

Identical rows cancel by multiplicity in one hash aggregation of both copies.  What is
left is paired inside each key so that the total number of differing fields is least,
whatever the number of rows.  Keys with one leftover on a side, nearly all in practice, are
paired in the JVM; others go through an assignment, one task for each key.

The assignment is primal-dual on whole numbers: a pair's worth is the number of fields it
shares, so dual values lie between 0 and the number of fields, and there are at most that
many rounds of augmenting paths over the pairs whose dual values are tight, whatever the
number of rows.  No pair is stored: the tight partners of many rows are found together, as
the rows that have the same values in a set of fields, so a task's memory grows with the
rows of its key and not with their square.
``pairing_bound`` gives a total that no pairing can go below, to hold the result against.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.runtime import ship

#: Rows of the smaller side that are compared pair by pair to see which fields they share; for
#: more, all sets of fields are tried.  Either way the same pairs are found.
MAX_EXACT = 8_000
#: Pairs compared in one strip.
STRIP = 1 << 18
#: Differing fields up to which ``pairing_bound`` counts.
STAGES = 2


def _words(codes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit word for each code, one line a field (splitmix64)."""
    x = codes.T.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shared_sets(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, most: int) -> list[tuple[tuple[int, ...], np.ndarray | slice, np.ndarray | slice]]:
    """(fields, rows, columns) in a fixed order, with all sets of fields in which tight pairs (sharing u + v fields) agree.

    The rows and columns are those of such pairs or more, and sets that no tight pair agrees
    in may be among them: what is too much finds nothing.
    """
    k, whole = a.shape[1], slice(None)
    sizes = sorted({int(x + y) for x in np.unique(u) for y in np.unique(v) if x + y <= k})
    if sizes == [0]:
        return [((), whole, whole)]
    number, pairs = sum(comb(k, s) for s in sizes), len(a) * len(b)
    if min(len(a), len(b)) > most or pairs * k > 200 * number * (750 + len(a) + len(b)):
        return [(c, whole, whole) for s in sizes for c in combinations(range(k), s)]
    met, kept = [], 0
    step, kind = max(1, STRIP // len(b)), np.int8 if k < 64 else np.int32
    ta, tb, v = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), v.astype(kind)
    for at in range(0, len(a), step):
        part = slice(at, at + step)
        lack = u[part, None].astype(kind) + v
        for f in range(k):
            lack -= (ta[f, part, None] == tb[f]).view(np.int8)
        i, j = np.nonzero(lack == 0)
        bits = np.packbits(a[part][i] == b[j], axis=1)
        kept += len(i)
        if kept > 16 * STRIP:  # too many to keep: only their sets
            met = [(np.unique(x, axis=0), None, None) for x, _, _ in [*met, (bits, None, None)]]
        else:
            met.append((bits, i + at, j))
    bits, which = np.unique(np.concatenate([x for x, _, _ in met]), axis=0, return_inverse=True)
    sets = [tuple(int(f) for f in np.flatnonzero(np.unpackbits(x, count=k))) for x in bits]
    if kept > 16 * STRIP:
        of = [(whole, whole)] * len(sets)
    else:
        i, j, which = np.concatenate([x for _, x, _ in met]), np.concatenate([x for _, _, x in met]), which.ravel()
        o = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[o], np.arange(len(sets) + 1))
        of = [(np.unique(i[o[x:y]]), np.unique(j[o[x:y]])) for x, y in zip(ends[:-1], ends[1:])]
    return sorted(((c, r, j) for c, (r, j) in zip(sets, of)), key=lambda x: (len(x[0]), x[0]))


def _assign(a: np.ndarray, b: np.ndarray, most: int = MAX_EXACT) -> np.ndarray:
    """Row of b for each row of a so that the fields shared are most; codes of fields, rows of a <= rows of b.

    All rows without a partner grow one alternating forest over the tight pairs (row value
    plus column value equal to the worth), layer by layer; a free column ends a path, which
    is turned over.  Without a path left the values of the forest's rows fall and those of
    its columns rise by one, which makes new pairs tight.

    A tight pair agrees in exactly as many fields as its values say and no pair in more, so
    for every set of that many fields the rows and columns with equal values in it are
    tight partners.  They meet by hashes; a meeting by chance is seen, and hashed anew.
    """
    n, m = len(a), len(b)
    # Fields with one value throughout, or none on both sides, count the same for every pair.
    keep = [f for f in range(a.shape[1]) if np.isin(a[:, f], b[:, f]).any() and not ((a[:, f] == a[0, f]).all() and (b[:, f] == a[0, f]).all())]
    a, b, k = a[:, keep].astype(np.int32), b[:, keep].astype(np.int32), len(keep)
    u, v = np.full(n, k), np.zeros(m, dtype=int)
    mate, owner = np.full(n, -1), np.full(m, -1)
    random = np.random.default_rng(0)

    def salted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        salt = random.integers(0, 1 << 63, 2 * k + 1, dtype=np.uint64)
        return _words(a, salt[:k]), _words(b, salt[:k]), salt[k:]

    wa, wb, level = salted()
    short, seen = np.uint64(44), np.zeros(1 << 20, dtype=bool)  # the first bits of words, to pass over most others
    while True:
        came, root, fresh = np.full(m, -1), np.full(n, -1), np.ones(m, dtype=bool)
        done, grown, chance = np.zeros(n, dtype=bool), False, False
        front = np.flatnonzero(mate < 0)
        if not front.size:
            return mate
        root[front] = front
        while front.size and not chance:
            cols = np.flatnonzero(fresh)
            uf, vf, free = u[front], v[cols], owner[cols] < 0
            ha, hb, live, open_ = wa[:, front], wb[:, cols], np.ones(len(front), dtype=bool), np.ones(len(cols), dtype=bool)
            levels, ends, later = (np.unique(uf), np.unique(vf)), [], []
            size = -1
            all_rows, all_cols = np.arange(len(front)), np.arange(len(cols))
            for fields, r, c in _shared_sets(a[front], b[cols], uf, vf, most):
                if size != len(fields):
                    size = len(fields)
                    row_fits, col_fits = np.isin(size - uf, levels[1]), np.isin(size - vf, levels[0])
                r, c = all_rows[r], all_cols[c]
                r, c = r[live[r] & row_fits[r]], c[open_[c] & col_fits[c]]
                if not r.size or not c.size:
                    continue
                kr, kc = level[size - uf[r]], level[vf[c]]
                for f in fields:
                    kr, kc = kr + ha[f, r], kc + hb[f, c]
                seen[kr >> short] = True
                may = seen[kc >> short]
                seen[kr >> short] = False
                c, kc = c[may], kc[may]
                if not c.size:
                    continue
                o = np.argsort(kr, kind="stable")
                r, kr = r[o], kr[o]
                first = np.searchsorted(kr, kc)
                first[first == len(kr)] = 0
                hit = kr[first] == kc
                if not hit.any():
                    continue
                c, first = c[hit], first[hit]
                taken = ~free[c]
                i, j = front[r[first[taken]]], cols[c[taken]]
                # Free columns: in each bucket the n-th goes to the n-th tree.
                cf, bucket = c[~taken], first[~taken]
                if cf.size:
                    o = np.argsort(bucket, kind="stable")
                    cf, bucket = cf[o], bucket[o]
                    rank = np.arange(len(cf)) - np.searchsorted(bucket, bucket)
                    home, tree = np.searchsorted(kr, kr), root[front[r]]
                    o = np.lexsort((tree, home))
                    one = np.ones(len(o), dtype=bool)
                    one[1:] = (home[o][1:] != home[o][:-1]) | (tree[o][1:] != tree[o][:-1])
                    o = o[one]
                    at = np.searchsorted(home[o], bucket) + rank
                    fits = at < np.searchsorted(home[o], bucket, side="right")
                    fi, cf = front[r[o[at[fits]]]], cf[fits]
                    _, once = np.unique(root[fi], return_index=True)
                    fi, cf = fi[once], cf[once]
                else:
                    fi = front[:0]
                fj, every = cols[cf], list(fields)
                if (a[np.ix_(i, every)] != b[np.ix_(j, every)]).any() or (a[np.ix_(fi, every)] != b[np.ix_(fj, every)]).any() or (u[i] + v[j] != size).any() or (u[fi] + v[fj] != size).any():
                    chance = True
                    break
                came[j], fresh[j], open_[c[taken]] = i, False, False
                root[owner[j]] = root[i]
                later.append(owner[j])
                if fi.size:
                    came[fj], fresh[fj], open_[cf] = fi, False, False
                    done[root[fi]] = True
                    live &= ~done[root[front]]
                    ends.append(fj)
            for j in (int(j) for e in ends for j in e):
                grown = True
                while j >= 0:
                    i = int(came[j])
                    before = int(mate[i])
                    mate[i], owner[j] = j, i
                    j = before
            front = np.sort(np.concatenate(later)) if later else front[:0]
            front = front[~done[root[front]]]
        if chance:
            wa, wb, level = salted()
        elif not grown:
            u[root >= 0] -= 1
            v[~fresh] += 1


def _pairs(a: np.ndarray, b: np.ndarray, most: int = MAX_EXACT) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a least-cost assignment of rows of codes, -1 where a row has no partner.

    Rows are sorted first, so the result doesn't depend on the order of arrival.
    """
    lo, ro = np.lexsort(a.T[::-1]), np.lexsort(b.T[::-1])
    if len(lo) > len(ro):
        j, i = _pairs(b, a, most)
        return i, j
    to = _assign(a[lo], b[ro], most) if len(lo) else lo
    alone = np.ones(len(ro), dtype=bool)
    alone[to] = False
    return np.concatenate([lo, np.full(alone.sum(), -1)]), np.concatenate([ro[to], ro[alone]])


def pair_leftovers(left: list[tuple], right: list[tuple], most: int = MAX_EXACT) -> list[tuple[int | None, int | None]]:
    """Index pairs of a least-cost assignment on differing-field counts; None has no partner.

    Rows are sorted first, so the result doesn't depend on the order of arrival.
    """
    fields = len((left or right or [()])[0])
    codes = np.zeros((len(left) + len(right), fields), dtype=int)
    for f in range(fields):
        texts = [x[f] for x in (*left, *right)]
        code = {x: n for n, x in enumerate(sorted(set(texts), key=lambda x: (x is not None, x or "")))}
        codes[:, f] = [code[x] for x in texts]
    name = lambda x: None if x < 0 else int(x)
    return [(name(i), name(j)) for i, j in zip(*_pairs(codes[: len(left)], codes[len(left) :], most))]


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: dict[str, tuple[Column, Column]],
    names: tuple[str, str] = ("left", "right"),
    exact_rows: int = MAX_EXACT,
) -> DataFrame:
    """Differences of two copies: key, ``diff``, ``field``, the two values and a count.

    ``fields`` maps a field name to its expression on either side; values are compared as
    text, null equals null and differs from everything else.  ``diff`` is
    ``only_in_<name>`` with field '' or ``value``.  ``n`` counts how often that difference
    occurs (repeated rows).  Rows with a null key form one key of their own.

    Within a key identical rows cancel by multiplicity, then leftovers are paired by
    minimum-cost assignment, copies of a row each for themselves, whatever their number.
    ``exact_rows`` says up to what size rows are compared pair by pair in the search for
    partners; the result doesn't depend on it.  Extra columns of either side are ignored.
    """
    names_ = list(fields)
    left_over = _left_over(left, right, key, fields)
    rows = left_over.groupBy("_k").agg(
        F.sum(F.when(F.col("_n") > 0, F.col("_n")).otherwise(0)).alias("_l"),
        F.sum(F.when(F.col("_n") < 0, -F.col("_n")).otherwise(0)).alias("_r"),
        F.max(F.when(F.col("_n") > 0, F.col("_v"))).alias("_lv"),
        F.max(F.when(F.col("_n") < 0, F.col("_v"))).alias("_rv"),
    )
    simple = rows.where("_l <= 1 and _r <= 1").select("_k", F.col("_lv").alias("_a"), F.col("_rv").alias("_b"), F.lit(1).cast("bigint").alias("n"))
    kinds = [f"f{n}" for n in range(len(names_))]
    hard = _paired(left_over, rows.where("_l > 1 or _r > 1").select("_k"), kinds, exact_rows)
    return _fields_of(simple.unionByName(hard), key, names_, names)


def _left_over(left: DataFrame, right: DataFrame, key: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(_k, _v, _n): +1 for each row of the left copy, -1 for each of the right, so equal rows cancel."""
    side = lambda df, i, d: df.select(
        F.col(key).alias("_k"), F.struct(*[F.coalesce(e[i].cast("string"), F.lit(None)).alias(f"f{n}") for n, e in enumerate(fields.values())]).alias("_v"), F.lit(d).alias("_d")
    )
    return side(left, 0, 1).unionAll(side(right, 1, -1)).groupBy("_k", "_v").agg(F.sum("_d").alias("_n")).where("_n <> 0")


def _all_but(kinds: list[str], differing: int) -> Column:
    """Hashes of a row without each choice of ``differing`` fields; equal hashes are equal fields but for collisions."""
    rest = [[k for k in kinds if k not in out] for out in combinations(kinds, differing)]
    # The choice and the null pattern are hashed too: xxhash64 alone skips nulls.
    part = lambda n, r: F.xxhash64(F.lit(n), *[x for k in r for x in (F.col(f"_v.{k}"), F.col(f"_v.{k}").isNull())])
    return F.array(*[part(n, r) for n, r in enumerate(rest)])


def _paired(left_over: DataFrame, keys: DataFrame, kinds: list[str], exact_rows: int) -> DataFrame:
    """Pairs of keys with several leftovers: one group a key, of any size."""
    ship(left_over.sparkSession)
    todo = left_over.alias("x").join(keys.alias("y"), F.col("x._k").eqNullSafe(F.col("y._k"))).select("x._k", "_n", *[F.col(f"_v.{k}").alias(k) for k in kinds])
    key_type = left_over.schema["_k"].dataType.simpleString()
    row_type = left_over.schema["_v"].dataType.simpleString()

    def solve(group: pa.Table) -> pa.Table:
        texts, codes = [], []
        for k in kinds:
            t = pa.concat_arrays(group[k].chunks)
            known = t.dictionary_encode()
            order = np.empty(len(known.dictionary), dtype=int)
            order[pc.sort_indices(known.dictionary).to_numpy()] = np.arange(len(order))
            at = known.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            codes.append(np.where(at < 0, -1, order[at] if len(order) else -1))
            texts.append(t)
        table, n = np.stack(codes, axis=1), group["_n"].to_numpy()
        # Copies of a row become rows of their own again: no more than were read.
        left, right = (np.repeat(np.flatnonzero(s * n > 0), np.abs(n[s * n > 0])) for s in (1, -1))
        i, j = _pairs(table[left], table[right], exact_rows)
        both = np.stack([np.where(i < 0, -1, left[i] if len(left) else -1), np.where(j < 0, -1, right[j] if len(right) else -1)], axis=1)
        both, times = np.unique(both, axis=0, return_counts=True)

        def rows(at: np.ndarray) -> pa.Array:
            index = pa.array(at, mask=at < 0)
            return pa.StructArray.from_arrays([t.take(index) for t in texts], names=kinds, mask=pa.array(at < 0))

        key = pa.concat_arrays(group["_k"].chunks).take(pa.array(np.zeros(len(both), dtype=int)))
        return pa.table({"_k": key, "_a": rows(both[:, 0]), "_b": rows(both[:, 1]), "n": pa.array(times, pa.int64())})

    return todo.groupBy("_k").applyInArrow(solve, f"_k {key_type}, _a {row_type}, _b {row_type}, n bigint")


def pairing_total(differences: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Per key the number of differing fields of all pairs of ``diff_copies``."""
    value = F.sum(F.when(F.col("diff") == "value", F.col("n")).otherwise(0))
    return differences.groupBy(key).agg(value.alias("differing"))


def pairing_bound(left: DataFrame, right: DataFrame, key: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per key a number of differing fields that no pairing can go below, as (key, pairs, least).

    A pair differs in at least one field, in two if its row of the smaller side agrees with
    no row of the other side in all fields but one, and so on up to STAGES + 1.
    """
    kinds = [f"f{n}" for n in range(len(fields))]
    rows = _left_over(left, right, key, fields).withColumn("_side", F.col("_n") > 0)
    sizes = rows.groupBy("_k").agg(F.sum(F.when(F.col("_side"), F.col("_n")).otherwise(0)).alias("_l"), F.sum(F.when(~F.col("_side"), -F.col("_n")).otherwise(0)).alias("_r")).where("_l > 0 and _r > 0")
    rows = rows.alias("x").join(sizes.alias("y"), F.col("x._k").eqNullSafe(F.col("y._k"))).where("_side = (_l <= _r)").select("x._k", "_v", "_n", F.least("_l", "_r").alias("pairs"), "_side").unionAll(
        rows.alias("x").join(sizes.alias("y"), F.col("x._k").eqNullSafe(F.col("y._k"))).where("_side <> (_l <= _r)").select("x._k", "_v", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), "_side")
    )  # rows of the larger side count for nothing but as partners
    deep = min(STAGES, len(kinds) - 1)
    met = None
    for differing in range(1, deep + 1):
        b = rows.select("_k", "_v", "_n", "pairs", F.explode(_all_but(kinds, differing)).alias("_b"))
        both = b.groupBy("_k", "_b").agg(F.max("_n").alias("_hi"), F.min("_n").alias("_lo"), F.min("pairs").alias("_z")).where("_z = 0 and _hi <> _lo").select(F.col("_k").alias("_bk"), F.col("_b").alias("_bb"))
        near = b.where("pairs > 0").join(both, b["_k"].eqNullSafe(F.col("_bk")) & (b["_b"] == F.col("_bb")), "left_semi").select("_k", "_v", F.lit(differing).alias("c"))
        met = near if met is None else met.unionAll(near)
    small = rows.where("pairs > 0")
    if met is None:
        costed = small.withColumn("c", F.lit(1))
    else:
        best = met.groupBy("_k", "_v").agg(F.min("c").alias("c"))
        costed = small.alias("x").join(best.alias("y"), F.col("x._k").eqNullSafe(F.col("y._k")) & (F.col("x._v").eqNullSafe(F.col("y._v"))), "left").select("x._k", "_n", "pairs", F.coalesce("c", F.lit(deep + 1)).alias("c"))
    return costed.groupBy("_k").agg(F.max("pairs").alias("pairs"), F.sum(F.abs("_n") * F.col("c")).alias("least")).select(F.col("_k").alias(key), "pairs", "least")


def _fields_of(pairs: DataFrame, key: str, fields: list[str], names: tuple[str, str]) -> DataFrame:
    null = F.lit(None).cast("string")
    entry = lambda diff, field, a, b: F.struct(F.lit(diff).alias("diff"), F.lit(field).alias("field"), a.alias("value_left"), b.alias("value_right"))
    values = [F.when(~F.col(f"_a.f{n}").eqNullSafe(F.col(f"_b.f{n}")), entry("value", f, F.col(f"_a.f{n}"), F.col(f"_b.f{n}"))) for n, f in enumerate(fields)]
    found = (
        F.when(F.col("_b").isNull(), F.array(entry(f"only_in_{names[0]}", "", null, null)))
        .when(F.col("_a").isNull(), F.array(entry(f"only_in_{names[1]}", "", null, null)))
        .otherwise(F.array_compact(F.array(*values)))
    )
    return pairs.select(F.col("_k").alias(key), F.explode(found).alias("_d"), "n").groupBy(key, "_d").agg(F.sum("n").alias("n")).select(key, "_d.*", "n")

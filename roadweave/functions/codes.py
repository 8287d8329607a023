"""Column expressions for codes, ids, lists, names and numbers (all inside generated code)."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Routing status to code (fixed values): 0 closed, 1 open, 2 local access only.
ROUTING_CODES = {"open": 1, "local_restricted": 2}
#: Default speeds in km/h by road class (fixed values).
CLASS_SPEED_KMH = {
    "motorway": 110, "motorway_link": 60, "trunk": 90, "trunk_link": 50, "primary": 70, "primary_link": 45, "secondary": 60, "secondary_link": 40,
    "tertiary": 50, "tertiary_link": 35, "unclassified": 40, "residential": 30, "living_street": 10,
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal_code(c: Column | str, width: int = 6) -> Column:
    """A numeric code as zero-padded text: outer blanks and a '.0' suffix are dropped.

    Longer codes stay as they are; null and empty give null.
    """
    bare = F.regexp_replace(F.trim(_c(c).cast("string")), "\\.0$", "")
    padded = F.when(F.length(bare) >= width, bare).otherwise(F.lpad(bare, width, "0"))
    return F.when(F.length(bare) > 0, padded)


def osm_id(c: Column | str) -> Column:
    """The number of '123', 'way/123' or 'w123'; null if the text has another form."""
    return F.regexp_extract(F.trim(_c(c).cast("string")), "^(?:[a-z]+/|[nwr])?([0-9]+)$", 1).try_cast("bigint")


def finite(c: Column | str) -> Column:
    """A finite double, else null."""
    x = _c(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def positive(c: Column | str) -> Column:
    x = finite(c)
    return F.when(x > 0, x)


def bounded_code(c: Column | str, domain: tuple[int, ...] = (0, 1, 2)) -> Column:
    """An integer code of the domain, else null."""
    x = _c(c).try_cast("int")
    return F.when(x.isin(*domain), x)


def split_list(c: Column | str, seps: str = "[|]") -> Column:
    """Non-empty trimmed items of a delimited text."""
    return F.filter(F.transform(F.split(_c(c), seps), lambda x: F.trim(x)), lambda x: x != "")


def join_list(c: Column | str, sep: str = "|") -> Column:
    return F.array_join(_c(c), sep)


def ref_token(c: Column | str) -> Column:
    """A road reference without anything but letters and digits, in upper case."""
    return F.regexp_replace(F.upper(_c(c)), "[^A-Z0-9]", "")


def ref_matches(road: Column | str, refs: Column | str) -> Column:
    """Whether a road is among the references packed in a text."""
    tokens = F.transform(F.split(F.coalesce(_c(refs), F.lit("")), "[;,/|]+"), ref_token)
    return F.coalesce(F.array_contains(F.filter(tokens, lambda t: t != ""), ref_token(road)), F.lit(False))


#: Latin letters without a decomposition and their bare letters (fixed values).
_UNDECOMPOSED = {"đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ı": "i"}


def _bare_letters() -> dict[str, str]:
    """Every Latin letter with marks and its bare letter, from the decompositions of Unicode."""
    out = dict(_UNDECOMPOSED)
    for n in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(n)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(n):
            out[chr(n)] = base
    return out


_MARKED, _BARE = ("".join(x) for x in zip(*sorted(_bare_letters().items())))


def fold_name(c: Column | str) -> Column:
    """A name key: without marks, composed or combining, in lower case, blanks squeezed."""
    bare = F.regexp_replace(F.translate(_c(c), _MARKED, _BARE), "\\p{Mn}+", "")
    return F.trim(F.regexp_replace(F.lower(bare), "\\s+", " "))


def first_tag(tags: Column, *names: str) -> Column:
    """The first tag that is there, in the order of priority."""
    return F.coalesce(*[tags[n] for n in names])


def tokens_overlap(c: Column | str, wanted: list[str], seps: str = "[;,]") -> Column:
    """Whether any item of a packed text is among ``wanted``."""
    return F.arrays_overlap(F.transform(F.split(F.lower(F.coalesce(_c(c), F.lit(""))), seps), lambda x: F.trim(x)), F.array(*[F.lit(w) for w in wanted]))


def percent_delta(new: Column, old: Column) -> Column:
    """100 (new - old) / old; null where old is zero."""
    return F.try_divide((new - old) * 100, old)


def safe_share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def peak_cost(n: Column, beta: Column) -> Column:
    """n / beta, where c^n exp(-beta c) is greatest; infinite for beta of zero or less with n above zero, 0 for n of zero."""
    return F.when(n <= 0, 0.0).when(beta <= 0, float("inf")).otherwise(n / beta)


def half_life(beta: Column) -> Column:
    """ln 2 / beta; infinite for beta of zero or less."""
    return F.when(beta <= 0, float("inf")).otherwise(F.log(F.lit(2.0)) / beta)


def deterrence(cost: Column, beta: Column, n: Column | None = None) -> Column:
    """exp(-beta c), or c^n exp(-beta c)."""
    return F.exp(-beta * cost) if n is None else F.exp(n * F.log(cost) - beta * cost)


def base_time_s(length_m: Column, speed_kmh: Column) -> Column:
    return length_m * 3.6 / speed_kmh


def direction_code(oneway: Column, junction: Column, highway: Column) -> Column:
    """1 forward only, -1 backward only, 0 both ways, null reversible or unknown."""
    o = F.lower(F.trim(oneway))
    return (
        F.when(o.isin("yes", "true", "1"), 1)
        .when(o.isin("-1", "reverse"), -1)
        .when(o.isin("no", "false", "0"), 0)
        .when(o.isNotNull(), F.lit(None))
        .when(junction.isin("roundabout", "circular") | highway.isin("motorway", "motorway_link"), 1)
        .otherwise(0)
    )


def model_speed(observed: Column, highway: Column) -> Column:
    """The class speed, or the observed one where it is lower."""
    table = F.create_map(*[F.lit(x) for kv in CLASS_SPEED_KMH.items() for x in (kv[0], float(kv[1]))])
    return F.least(table[highway], observed)  # least skips nulls


def bitmask(index: Column) -> Column:
    """1 shifted to the place of an index from 0 to 63; masks join by ``bit_or``."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), index)


def has_bit(mask: Column, index: Column) -> Column:
    """Whether the place of an index, 0 to 63, is set."""
    return F.call_function("shiftright", mask, index).bitwiseAND(F.lit(1).cast("bigint")) == 1


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


#: Access tag values by class (fixed values): what cars may do, most open first.
ACCESS_CLASSES = {
    "open": ("yes", "permissive", "designated", "official"),
    "local_restricted": ("destination", "customers", "delivery", "residents"),
    "permission_restricted": ("private", "permit"),
    "authorized_only": ("agricultural", "forestry", "emergency", "psv", "bus"),
    "prohibited": ("no",),
}
#: Routing code of each access class (fixed values).
ACCESS_CODES = {"open": 1, "local_restricted": 2, "permission_restricted": 0, "authorized_only": 0, "prohibited": 0}


def access_class(tags: Column, way: str | None = None) -> Column:
    """The class of the first access tag that is there, from the most specific to ``access``; open without any.

    ``way`` (forward or backward) puts the tags of that direction before the general ones of
    the same name.  A value of no class is prohibited, as nothing allows it.
    """
    names = [n for base in ("motorcar", "motor_vehicle", "vehicle", "access") for n in ([f"{base}:{way}", base] if way else [base])]
    value = F.lower(F.trim(first_tag(tags, *names)))
    out = F.when(value.isNull(), "open")
    for name, values in ACCESS_CLASSES.items():
        out = out.when(value.isin(*values), name)
    return out.otherwise("prohibited")


def routing_status(access: Column, closed_direction: Column) -> Column:
    """closed_direction, closed_access, local_restricted or open; a closed direction counts first."""
    code = F.create_map(*[F.lit(x) for kv in ACCESS_CODES.items() for x in kv])[access]
    return F.when(closed_direction, "closed_direction").when(code == 0, "closed_access").when(code == 2, "local_restricted").otherwise("open")


def annual(daily: Column, days: float = 365.0) -> Column:
    """A daily amount over a year of ``days`` days."""
    return daily * F.lit(float(days))


def thinned(flow: Column, *shares: Column | float) -> Column:
    """A flow reduced by shares one after another; a share outside 0 to 1 gives null."""
    out = flow
    for s in shares:
        c = s if isinstance(s, Column) else F.lit(float(s))
        out = out * F.when((c >= 0) & (c <= 1), c)
    return out


def swapped(flag: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Two columns, exchanged where the flag is set (null counts as not set)."""
    on = F.coalesce(flag, F.lit(False))
    return F.when(on, b).otherwise(a), F.when(on, a).otherwise(b)

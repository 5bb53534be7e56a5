"""Parts of DuckDB's SQL that several oracles share: distances, alignments and matches of two lists."""


def common(a: str, b: str) -> str:
    return f"list_intersect(list_distinct({a}), list_distinct({b}))"


def coded(x: str, shared: str, other: int) -> str:
    """One byte for each element: its place among the shared ones, or ``other``; what only one side has equals nothing."""
    return f"coalesce(list_aggregate(list_transform({x}, lambda v: chr(coalesce(nullif(list_position({shared}, v), 0), {other})::INTEGER)), 'string_agg', ''), '')"


def plain_distance(p: str, t: str) -> str:
    row = f"list_reduce(range(1, len({t}) + 1), lambda acc, j: list_append(acc, CASE WHEN {p}[i] = {t}[j] THEN row[j] ELSE 1 + least(row[j], row[j + 1], acc[j]) END), [i])"
    return f"list_reduce(range(1, len({p}) + 1), lambda row, i: {row}, range(0, len({t}) + 1))[-1]"


def distance(a: str, b: str, shared: str) -> str:
    """Levenshtein's distance of two lists: of bytes where they share at most 125 elements, else by its table. ``shared``: their common elements."""
    return f"CASE WHEN {a} = {b} THEN 0 WHEN len({shared}) <= 125 THEN levenshtein({coded(a, shared, 126)}, {coded(b, shared, 127)}) ELSE {plain_distance(a, b)} END"


def symbols(x: str) -> str:
    """Words of a text, breaks and tabs as words of their own."""
    return f"string_split(replace(replace({x}, chr(10), ' <b> '), chr(9), ' <t> '), ' ')"


def characters(x: str) -> str:
    """Characters of a text without blanks, but for break and tab symbols."""
    return f"list_filter(flatten(list_transform({symbols(x)}, lambda w: CASE WHEN w IN ('<b>', '<t>') THEN [w] ELSE string_split(w, '') END)), lambda c: c <> '')"


def text_lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


SYMBOLS = {"cer": characters, "ser": symbols, "ler": text_lines}

#: Places of the counters of an alignment within one number: cost, substitutions, insertions, deletions, matched dots.
COST, SUBSTITUTED, INSERTED, DELETED = 10**15, 10**12, 10**8, 10**4


def alignment(p: str, t: str, dot: str = "'.'") -> str:
    """Counters of the alignment that prefers match, substitution, insertion and deletion in turn, in one number."""
    row = (
        f"list_reduce(range(1, len({t}) + 1), lambda acc, j: list_append(acc, CASE WHEN {p}[i] = {t}[j] THEN row[j] + ({t}[j] = {dot})::INT "
        f"WHEN row[j] // {COST} <= row[j + 1] // {COST} AND row[j] // {COST} <= acc[j] // {COST} THEN row[j] + {COST + SUBSTITUTED} "
        f"WHEN row[j + 1] // {COST} <= acc[j] // {COST} THEN row[j + 1] + {COST + INSERTED} ELSE acc[j] + {COST + DELETED} END), [row[1] + {COST + INSERTED}])"
    )
    return f"list_reduce(range(1, len({p}) + 1), lambda row, i: {row}, list_transform(range(0, len({t}) + 1), lambda j: j * {COST + DELETED}))[-1]"


def counters(x: str, t: str) -> dict[str, str]:
    """Columns of a number that ``alignment`` made, ``t`` being the truth."""
    s, i, d, dots = f"({x} // {SUBSTITUTED} % 1000)", f"({x} // {INSERTED} % 10000)", f"({x} // {DELETED} % 10000)", f"({x} % {DELETED})"
    matches = f"(len({t}) - {s} - {d})"
    return {"edit_distance": f"({x} // {COST})", "matches": matches, "dot_matches": dots, "chord_matches": f"({matches} - {dots})", "substitutions": s, "insertions": i, "deletions": d}


def path(p: str, t: str) -> str:
    """The steps of the same alignment as letters m, s, i and d, after a cost of four digits."""
    cost = lambda c: f"substr({c}, 1, 4)::INT"
    on = lambda c, more, step: f"lpad(({cost(c)} + {more})::VARCHAR, 4, '0') || substr({c}, 5) || '{step}'"
    row = (
        f"list_reduce(range(1, len({t}) + 1), lambda acc, j: list_append(acc, CASE WHEN {p}[i] = {t}[j] THEN {on('row[j]', 0, 'm')} "
        f"WHEN {cost('row[j]')} <= {cost('row[j + 1]')} AND {cost('row[j]')} <= {cost('acc[j]')} THEN {on('row[j]', 1, 's')} "
        f"WHEN {cost('row[j + 1]')} <= {cost('acc[j]')} THEN {on('row[j + 1]', 1, 'i')} ELSE {on('acc[j]', 1, 'd')} END), [{on('row[1]', 1, 'i')}])"
    )
    first = f"list_transform(range(0, len({t}) + 1), lambda j: lpad(j::VARCHAR, 4, '0') || repeat('d', j::INT))"
    return f"substr(list_reduce(range(1, len({p}) + 1), lambda row, i: {row}, {first})[-1], 5)"


def steps(rows: str, keys: str, p: str = "pred", t: str = "truth") -> str:
    """A query of (keys, op, ti, pi): steps of ``rows`` with places from 0, null where there is none."""
    return f"""
SELECT {keys}, op, CASE WHEN op <> 'i' THEN len(replace(substr(path, 1, n::INT), 'i', '')) - 1 END AS ti, CASE WHEN op <> 'd' THEN len(replace(substr(path, 1, n::INT), 'd', '')) - 1 END AS pi,
       CASE WHEN op = 'i' THEN len(replace(substr(path, 1, n::INT), 'i', '')) - 1 END AS after, path, {p}, {t}
FROM (SELECT *, path[n::INT] AS op FROM (SELECT *, unnest(range(1, length(path) + 1)) AS n FROM (SELECT *, {path(p, t)} AS path FROM {rows})))"""


def common_subsequence(p: str, t: str) -> str:
    row = f"list_reduce(range(1, len({t}) + 1), lambda acc, j: list_append(acc, greatest(row[j + 1], acc[j], row[j] + ({p}[i] = {t}[j])::INT)), [0::BIGINT])"
    return f"list_reduce(range(1, len({p}) + 1), lambda row, i: {row}, list_transform(range(0, len({t}) + 1), lambda j: 0::BIGINT))[-1]"


def windowed(p: str, t: str, reach: int = 3) -> str:
    """Each element of the truth takes the nearest free equal one, earlier before later."""
    shifts = "[" + ", ".join(str(d) for d in sorted(range(-reach, reach + 1), key=lambda d: (abs(d), d))) + "]"
    free = f"list_filter({shifts}, lambda d: i + d BETWEEN 1 AND len({p}) AND NOT list_contains(taken, i + d) AND coalesce({p}[i + d] = {t}[i], false))"
    return f"len(list_reduce(range(1, len({t}) + 1), lambda taken, i: CASE WHEN len({free}) > 0 THEN list_append(taken, i + {free}[1]) ELSE taken END, []::BIGINT[]))"


def normal_tail(z: str, parts: int = 2000) -> str:
    """P(Z > z) of the normal distribution, by Simpson's rule over ``parts`` steps."""
    at = f"(least(greatest({z}, -9), 9) * i / {parts})"
    return f"(0.5 - list_sum(list_transform(range(0, {parts + 1}), lambda i: (CASE WHEN i = 0 OR i = {parts} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-{at} * {at} / 2))) * least(greatest({z}, -9), 9) / {parts} / 3 / sqrt(2 * pi()))"


def signed_rank_tail(n: str, w: str) -> str:
    """P(W+ >= w) by counting the sign patterns of n ranks."""
    size = f"({n} * ({n} + 1) // 2)"
    ways = f"list_reduce(range(1, {n} + 1), lambda ways, r: list_transform(range(0, {size} + 1), lambda v: ways[v + 1] + CASE WHEN v >= r THEN ways[v - r + 1] ELSE 0 END), list_transform(range(0, {size} + 1), lambda v: (v = 0)::INT::DOUBLE))"
    return f"(list_sum(list_slice({ways}, ceil({w})::BIGINT + 1, {size} + 1)) / 2.0 ** {n})"

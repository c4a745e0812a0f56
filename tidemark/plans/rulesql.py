"""DuckDB SQL of rules, for comparing them: the same data, written out as list functions over an array of tokens ``w``."""

from __future__ import annotations

from tidemark.operators.rules import Accept, Guard, LabelGuard, Near, Not, Part, PlaceGuard, Rule


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def token(x: str, prefixes=(), words=()) -> str:
    tests = [f"starts_with({x}, {_quoted(p)})" for p in prefixes]
    if words:
        tests.append(f"{x} in ({', '.join(map(_quoted, words))})")
    return "(" + " or ".join(tests) + ")"


def _window(before: int, after: int) -> str:
    return f"list_slice(w, greatest(1, i - ({before})), i + ({after}))"


def near(n: Near | Not) -> str:
    if isinstance(n, Not):
        return f"not {near(n.near)}"
    return f"(len(list_filter({_window(*n.reach())}, lambda x: {token('x', n.prefixes, n.words)})) > 0)"


def _first(window: str, label: str) -> str:
    return f"list_filter(list_transform({window}, lambda x: {label}), lambda y: y is not null)[1]"


def _labels(labels: dict[str, str]) -> str:
    return "case " + " ".join(f"when starts_with(x, {_quoted(k)}) then {_quoted(v)}" for k, v in labels.items()) + " end"


def _steps(part: Part) -> str:
    out = []
    for s in part.steps:
        if isinstance(s, Guard):
            out.append(f"when {' and '.join(map(near, s.all_of))} then {_quoted(s.name)}")
        elif isinstance(s, Accept):
            out.append(f"when {' and '.join(map(near, s.all_of))} then null")
        elif isinstance(s, LabelGuard):
            label = _first(_window(s.radius, s.radius), _labels(s.labels))
            out.append(f"when {label} is not null then {_quoted(s.name + ':')} || {label}")
        elif isinstance(s, PlaceGuard):
            marked = {**{a: f"adj:{a}" for a in s.adjectives}, **{a: f"leader:{a}" for a in s.leaders}}
            label = _first(_window(s.radius, s.radius), "map_extract(gaz, x)[1]")
            if marked:
                label = f"coalesce({label}, {_first(_window(s.radius, s.radius), _labels(marked))})"
            out.append(f"when {label} is not null then {_quoted(s.name + ':')} || {label}")
    other = _quoted(part.otherwise) if part.otherwise else "null"
    return f"case {' '.join(out)} else {other} end" if out else other


_ALL = "generate_series(1, len(w))"


def positions(part: Part) -> str:
    lists = []
    if part.prefixes:
        lists.append(f"list_filter({_ALL}, lambda i: {token('w[i]', part.prefixes)})")
    if part.words:
        lists.append(f"list_filter({_ALL}, lambda i: {token('w[i]', (), part.words)})")
    for a, b in part.pairs:
        first = token("w[i]", (), (a[1:],)) if a.startswith("=") else token("w[i]", (a,))
        found = f"list_filter({_ALL}, lambda i: {first} and len(list_filter(list_slice(w, i + 1, i + {part.gap}), lambda x: {token('x', (b,))})) > 0)"
        if part.at_second:
            found = f"list_transform({found}, lambda i: list_filter(generate_series(i + 1, least(i + {part.gap}, len(w))), lambda j: {token('w[j]', (b,))})[1])"
        lists.append(found)
    return lists[0] if len(lists) == 1 else "list_concat(" + ", ".join(lists) + ")" if len(lists) == 2 else f"flatten([{', '.join(lists)}])"


def judged(rule: Rule) -> str:
    """List of ``{'i', 'g'}``: the positions of a rule and the guard at each, null where it is accepted."""
    parts = [f"list_transform({positions(p)}, lambda i: {{'i': i, 'g': {_steps(p)}}})" for p in rule.all_parts()]
    out = f"flatten([{', '.join(parts)}])"
    return f"list_sort({out})" if rule.in_order else out


def verdicts(rules, docs: str, key: str) -> str:
    """``key, term, grp, status, guard, guarded`` of every rule that isn't silent, from a table with ``key``, ``w`` and ``gaz``."""
    selects = []
    for r in rules:
        partner = token("x", r.partner.prefixes, r.partner.words) if r.partner else None
        here = f"len(list_filter(w, lambda x: {partner})) > 0" if r.partner else "true"
        close = near(r.partner).replace(" i ", " q.i ").replace("(1, i -", "(1, q.i -").replace("), i +", "), q.i +") if r.partner else "true"
        clean = " or ".join(f"len({positions(p)}) > 0" for p in r.clean_if) or "false"
        selects.append(
            f"select {key}, {_quoted(r.name)} as term, {_quoted(r.group)} as grp, p, {clean} as clean, len(list_filter(p, lambda q: (q.g is null or {clean}) and {close})) > 0 as near_any, {_quoted(r.partner_guard)} as far_guard "
            f"from (select *, {judged(r)} as p from {docs}) where len(p) > 0 and {here}"
        )
    return f"""(select {key}, term, grp, case when taken and near_any then 'match' else 'excluded' end as status,
  case when taken and near_any then null when taken then far_guard else list_filter(p, lambda q: q.g is not null)[-1].g end as guard, len(list_filter(p, lambda q: q.g is not null)) > 0 as guarded
  from (select *, clean or len(list_filter(p, lambda q: q.g is null)) > 0 as taken from ({' union all '.join(selects)})))"""


def gazetteer(names: dict[str, str]) -> str:
    """A table of one row with the map ``gaz``."""
    return f"(select map([{', '.join(map(_quoted, names))}], [{', '.join(map(_quoted, names.values()))}]) as gaz)"

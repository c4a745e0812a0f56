"""Plain Python versions of the text problems, to compare the operators with."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

from tidemark.llm.lookalike import load

folded, look = load().folded, load().look


def words(text):
    """Runs of letters and digits of the folded text, a character at a time."""
    out, run = [], ""
    for ch in folded(text or "") + " ":
        if unicodedata.category(ch)[0] in "LN":
            run += ch
        elif run:
            out.append(run)
            run = ""
    return out


def channel(name):
    return None if name is None else name.lower().lstrip("@")


def line_form(line):
    return " ".join(look(line).lower().split())


def repeated_lines(rows, least=10):
    """rows: (id, channel, text).  {(id, line_no)}"""
    holders, places = defaultdict(set), []
    for i, name, text in rows:
        for n, line in enumerate((text or "").split("\n") if text is not None else [], 1):
            if (form := line_form(line)) and name is not None:
                holders[channel(name), form].add(i)
                places.append((i, n, channel(name), form))
    return sorted((i, n) for i, n, c, f in places if len(holders[c, f]) >= least)


def same_look(rows):
    by = defaultdict(list)
    for i, text in rows:
        if text is not None:
            by[look(text)].append((i, text))
    return {(min(a, b), max(a, b)) for v in by.values() if len(v) > 1 for a, s in v for b, t in v if s != t}


def similar(rows, size, least):
    sets = [(i, words(t)) for i, t in rows if t is not None]
    sets = [(i, frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)), tuple(w)) for i, w in sets]
    where, common = defaultdict(list), Counter()
    for n, (_, s, _) in enumerate(sets):
        for x in s:
            where[x].append(n)
    for v in where.values():
        for p in range(len(v)):
            for q in range(p + 1, len(v)):
                common[v[p], v[q]] += 1
    out = set()
    for (p, q), n in common.items():
        a, b = sets[p], sets[q]
        if n / (len(a[1]) + len(b[1]) - n) >= least:
            out.add((min(a[0], b[0]), max(a[0], b[0])))
    short = defaultdict(list)
    for i, s, w in sets:
        if not s:
            short[w].append(i)
    out |= {(min(a, b), max(a, b)) for v in short.values() for a in v for b in v if a != b}
    return {(a, b) for a, b in out if a != b}


def shared_spans(rows, length):
    holders = defaultdict(set)
    for i, t in rows:
        for p in range(len(t or "") - length + 1):
            holders[t[p : p + length]].add(i)
    out = []
    for i, t in rows:
        mark = bytearray(len(t or ""))
        for p in range(len(t or "") - length + 1):
            if len(holders[t[p : p + length]]) > 1:
                mark[p : p + length] = b"\1" * length
        out += [(i, m.start() + 1, m.end() - m.start()) for m in re.finditer(b"\1+", bytes(mark))]
    return sorted(out)


def leaked(docs, items, n):
    where = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in where.get(tuple(w[k : k + n]), ())}
    return out


def aligned(a, b, edits):
    """The most equal words in an alignment of successive words of a and b with up to so many edits of words."""
    none = [-1] * (edits + 1)
    above, best = [none] * (len(b) + 1), 0
    for x in [None, *a]:
        row = []
        for j in range(len(b) + 1):
            cell = [0] * (edits + 1)
            for e in range(edits + 1):
                if x is not None and j and x == b[j - 1]:
                    cell[e] = max(cell[e], above[j - 1][e] + 1)
                if e:
                    cell[e] = max(cell[e], above[j][e - 1], *((row[j - 1][e - 1], above[j - 1][e - 1]) if j else ()))
            row.append(cell)
            best = max(best, *cell)
        above = row
    return best


def not_prose(docs, stops):
    space = re.compile("[\t-\r \x85\xa0  -     　]")
    strip = re.compile(f"^{space.pattern}+|{space.pattern}+$")
    out = set()
    for d, t in docs:
        if t is None or not space.sub("", t):
            continue
        kinds = "".join("w" if unicodedata.category(c)[0] in "LN" else "s" if space.match(c) else "o" for c in t)
        w = [t[m.start() : m.end()] for m in re.finditer("w+", kinds)]
        lines = [x for x in (strip.sub("", x) for x in t.split("\n")) if x]
        letters, visible = kinds.count("w"), len(t) - kinds.count("s")
        if (
            len(w) < 8
            or not 3 * len(w) <= letters <= 10 * len(w)
            or 10 * (visible - letters) > 3 * visible
            or 2 * sum(x[-1] in ".!?…" for x in lines) < len(lines)
            or 10 * sum(x.lower() in stops for x in w) < len(w)
        ):
            out.add(d)
    return out

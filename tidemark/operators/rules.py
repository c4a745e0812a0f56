"""A rule language for term matching: triggers, guards and requirements over token windows.

A rule is data.  Its parts say where a term may stand and, step by step, what
rejects or accepts it there; a text matches if a position is accepted, else the last
guard is reported.  Rules are compiled to classes of tokens: a token is looked up
once for all rules, and only where it is of some class anything is tested.  Texts are
judged in Arrow batches, a batch of token arrays in and one of verdicts out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.functions.text import hashtag_only, joined

#: Where the tokens of a text's classes stand.
Doc = dict[int, list[int]]
Test = Callable[[Doc, int], bool]


class TokenClasses:
    """Classes of tokens, each of some prefixes and words; classes with labels also name what a token stands for."""

    def __init__(self):
        self.classes: list[tuple[tuple[str, ...], frozenset[str]]] = []
        self.labels: list[tuple[Mapping[str, str], bool]] = []
        self._ids: dict = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._named: dict[tuple[int, str], str | None] = {}
        self._firsts: set[str] | None = None

    def add(self, prefixes: Iterable[str], words: Iterable[str] = ()) -> int:
        key = (tuple(prefixes), frozenset(words))
        if key not in self._ids:
            self._ids[key] = len(self.classes)
            self.classes.append(key)
        return self._ids[key]

    def of(self, token: str) -> tuple[int, ...]:
        known = self._known.get(token)
        if known is None:
            if self._firsts is None:
                self._firsts = {x[:2] for prefixes, words in self.classes for x in (*prefixes, *words)}
            known = ()
            if token[:2] in self._firsts or token[:1] in self._firsts:
                known = tuple(i for i, (prefixes, words) in enumerate(self.classes) if token in words or token.startswith(prefixes))
            if len(self._known) < 500_000:
                self._known[token] = known
        return known

    def places(self, tokens: list[str]) -> Doc:
        out: Doc = {}
        for i, token in enumerate(tokens):
            for c in self.of(token):
                out.setdefault(c, []).append(i)
        return out


@dataclass(frozen=True)
class Near:
    """Some token from ``before`` to ``after`` (``radius`` if not given) begins with one of ``prefixes`` or is one of ``words``.

    The position itself is in the window; ``before=-1, after=1`` is the next token alone.
    """

    radius: int = 0
    prefixes: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    before: int | None = None
    after: int | None = None

    def reach(self) -> tuple[int, int]:
        return (self.radius if self.before is None else self.before), (self.radius if self.after is None else self.after)

    def test(self, classes: TokenClasses) -> Test:
        c = classes.add(self.prefixes, self.words)
        before, after = self.reach()
        return lambda doc, i: any(-before <= p - i <= after for p in doc.get(c, ()))


@dataclass(frozen=True)
class Not:
    near: Near

    def test(self, classes: TokenClasses) -> Test:
        inner = self.near.test(classes)
        return lambda doc, i: not inner(doc, i)


@dataclass(frozen=True)
class Guard:
    """Rejects a position, as ``name``, if all of ``all_of`` hold there."""

    name: str
    all_of: tuple[Near | Not, ...]

    def step(self, classes: TokenClasses):
        tests = [n.test(classes) for n in self.all_of]
        return lambda doc, tokens, i: self.name if all(t(doc, i) for t in tests) else None


@dataclass(frozen=True)
class Accept:
    """Accepts a position, whatever guards follow, if all of ``all_of`` hold there."""

    all_of: tuple[Near | Not, ...]

    def step(self, classes: TokenClasses):
        tests = [n.test(classes) for n in self.all_of]
        return lambda doc, tokens, i: "" if all(t(doc, i) for t in tests) else None


@dataclass(frozen=True)
class LabelGuard:
    """Rejects a position with a labelled token near it, as ``name:label``; of several keys of a token the first counts."""

    name: str
    radius: int
    labels: dict[str, str] = field(hash=False)

    def step(self, classes: TokenClasses):
        c = classes.add(self.labels)

        def step(doc: Doc, tokens: list[str], i: int) -> str | None:
            for p in doc.get(c, ()):
                if abs(p - i) <= self.radius:
                    return f"{self.name}:" + next(v for k, v in self.labels.items() if tokens[p].startswith(k))
            return None

        return step


@dataclass(frozen=True)
class PlaceGuard:
    """Rejects a position near a country, as ``name:country``, or else near an adjective or leader of one, as ``name:adj:stem`` or ``name:leader:stem``.

    ``names`` maps tokens to the one country they stand for; see :mod:`tidemark.operators.places`.
    Countries are looked for first, in the order of the tokens; then each token's
    adjectives before its leaders.
    """

    name: str
    radius: int
    names: dict[str, str] = field(hash=False)
    adjectives: tuple[str, ...] = ()
    leaders: tuple[str, ...] = ()

    def step(self, classes: TokenClasses):
        c, marked = classes.add((), self.names), classes.add((*self.adjectives, *self.leaders))

        def step(doc: Doc, tokens: list[str], i: int) -> str | None:
            for p in doc.get(c, ()):
                if abs(p - i) <= self.radius:
                    return f"{self.name}:{self.names[tokens[p]]}"
            for p in doc.get(marked, ()):
                if abs(p - i) <= self.radius:
                    for kind, stems in (("adj", self.adjectives), ("leader", self.leaders)):
                        for stem in stems:
                            if tokens[p].startswith(stem):
                                return f"{self.name}:{kind}:{stem}"
            return None

        return step


Step = Guard | Accept | LabelGuard | PlaceGuard


@dataclass(frozen=True)
class Part:
    """Where a term may stand: tokens with a prefix, exact words, pairs within ``gap`` tokens; and the steps that judge it there.

    Pairs are of prefixes; a first one that begins with ``=`` is a whole word.

    The first step that fires decides; if none does, the position is accepted, or
    rejected as ``otherwise`` if that is given.  Pairs are judged where their first
    token stands, or their second with ``at_second``.
    """

    prefixes: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()
    steps: tuple[Step, ...] = ()
    otherwise: str | None = None
    gap: int = 2
    at_second: bool = False

    def compiled(self, classes: TokenClasses):
        singles = [c for c in (self.prefixes and classes.add(self.prefixes), self.words and classes.add((), self.words)) if c != ()]
        pairs = [(classes.add((), (a[1:],)) if a.startswith("=") else classes.add((a,)), classes.add((b,))) for a, b in self.pairs]
        steps = [s.step(classes) for s in self.steps]

        def positions(doc: Doc) -> list[int]:
            out = [i for c in singles for i in doc.get(c, ())]
            for a, b in pairs:
                if a in doc and b in doc:
                    for i in doc[a]:
                        j = next((j for j in doc[b] if i < j <= i + self.gap), None)
                        if j is not None:
                            out.append(j if self.at_second else i)
            return out

        def judged(doc: Doc, tokens: list[str], i: int) -> str | None:
            for step in steps:
                reason = step(doc, tokens, i)
                if reason is not None:
                    return reason or None
            return self.otherwise

        return positions, judged


@dataclass(frozen=True)
class Rule:
    """A term.  ``prefixes``, ``words``, ``pairs``, ``guards`` and ``requires`` make its first part, ``parts`` are further ones.

    ``hashtag`` is a stem that doesn't count where every one of it is a hashtag;
    ``sources`` are sources whose own name the term is, so that it is not looked for
    there (guard ``self_channel``).  If one of ``clean_if`` stands anywhere in the text,
    guarded positions count as accepted.  ``in_order`` takes positions in the order of
    the text instead of part by part.  With ``partner`` an accepted position must have it
    near, else the text is rejected as ``partner_guard``, and without it anywhere the
    rule is silent.
    """

    name: str
    group: str
    prefixes: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()
    guards: tuple[Step, ...] = ()
    requires: Near | None = None
    gap: int = 2
    at_second: bool = False
    parts: tuple[Part, ...] = ()
    hashtag: str | None = None
    sources: tuple[str, ...] = ()
    clean_if: tuple[Part, ...] = ()
    in_order: bool = False
    partner: Near | None = None
    partner_guard: str = ""

    def all_parts(self) -> tuple[Part, ...]:
        steps, otherwise = self.guards, None
        if self.requires is not None:
            steps, otherwise = (*steps, Accept((self.requires,))), f"{self.name}_no_context"
        first = Part(self.prefixes, self.words, self.pairs, steps, otherwise, self.gap, self.at_second)
        return (first, *self.parts) if self.prefixes or self.words or self.pairs else self.parts

    def compiled(self, classes: TokenClasses):
        parts = [p.compiled(classes) for p in self.all_parts()]
        clean = [p.compiled(classes)[0] for p in self.clean_if]
        near = self.partner and self.partner.test(classes)
        partner = self.partner and classes.add(self.partner.prefixes, self.partner.words)

        def verdict(doc: Doc, tokens: list[str], tagged: list[str], source: str | None) -> dict | None:
            if source is not None and source in self.sources:
                return {"term": self.name, "grp": self.group, "status": "excluded", "guard": "self_channel", "guarded": False, "guards": ["self_channel"]}
            if partner is not None and partner not in doc:
                return None
            found = [(i, judged) for positions, judged in parts for i in positions(doc)]
            if not found:
                return None
            if self.name in tagged:
                return {"term": self.name, "grp": self.group, "status": "excluded", "guard": "hashtag_only", "guarded": False, "guards": ["hashtag_only"]}
            if self.in_order:
                found.sort(key=lambda x: x[0])
            reasons = [(i, judged(doc, tokens, i)) for i, judged in found]
            guards = [r for _, r in reasons if r is not None]
            accepted = [i for i, r in reasons if r is None]
            guarded = bool(guards)
            if guards and any(positions(doc) for positions in clean):
                accepted, guards = [i for i, _ in reasons], []
            guard = guards[-1] if guards else None
            if accepted and near and not any(near(doc, i) for i in accepted):
                accepted, guard = [], self.partner_guard
                guards = [*guards, guard]
            return {"term": self.name, "grp": self.group, "status": "match" if accepted else "excluded", "guard": None if accepted else guard, "guarded": guarded, "guards": guards}

        return verdict

    def verdict(self, tokens: Column) -> Column:
        """Struct of this rule's verdict on a token array; null where it is silent."""
        return F.get(judged((self,))(tokens, F.array().cast("array<string>"), F.lit(None).cast("string")), F.lit(0))


_VERDICT = pa.struct([("term", pa.string()), ("grp", pa.string()), ("status", pa.string()), ("guard", pa.string()), ("guarded", pa.bool_()), ("guards", pa.list_(pa.string()))])
_VERDICT_SQL = "array<struct<term:string,grp:string,status:string,guard:string,guarded:boolean,guards:array<string>>>"


def judge(rules: Iterable[Rule]) -> Callable[[list[str], list[str], str | None], list[dict]]:
    """The rules as a plain function of tokens, names of hashtag-only rules and source."""
    classes = TokenClasses()
    verdicts = [r.compiled(classes) for r in rules]

    def run(tokens: list[str], tagged: list[str] = (), source: str | None = None) -> list[dict]:
        doc = classes.places(tokens)
        if not doc and source is None:
            return []
        return [v for v in (verdict(doc, tokens, tagged, source) for verdict in verdicts) if v is not None]

    return run


def judged(rules: Iterable[Rule]):
    """The rules as a function of three columns: tokens, names of hashtag-only rules, source."""
    rules = tuple(rules)
    run = None

    @F.arrow_udf(_VERDICT_SQL)
    def judge_batch(tokens: pa.Array, tagged: pa.Array, source: pa.Array) -> pa.Array:
        nonlocal run
        if run is None:
            run = judge(rules)
        rows = zip(tokens.to_pylist(), tagged.to_pylist(), source.to_pylist())
        return pa.array([run(t or (), g or (), s) for t, g, s in rows], pa.list_(_VERDICT))

    # Marked so that the optimiser neither repeats it nor moves it into a filter.
    return judge_batch.asNondeterministic()


def apply_rules(df: DataFrame, rules: Iterable[Rule], tokens_col: str = "tokens", norm: Column | None = None, source: Column | None = None) -> DataFrame:
    """``df`` with ``verdicts``: an array of the rules' structs ``term, grp, status, guard, guarded, guards`` that aren't silent.

    ``guarded`` tells whether a guard fired at any position, ``guards`` has all that
    did.  ``norm`` is the normalised text, for rules with a hashtag; ``source`` the name
    of the source, for rules that are silent in their own.
    """
    rules = tuple(rules)
    tags = [F.when(hashtag_only(norm, r.hashtag), F.lit(r.name)) for r in rules if r.hashtag and norm is not None]
    tagged = F.array_compact(F.array(*tags)) if tags else F.array().cast("array<string>")
    return df.withColumn("verdicts", judged(rules)(F.col(tokens_col), tagged, F.lit(None).cast("string") if source is None else source))


def terms(verdicts: Column) -> Column:
    """Matched terms, sorted, separated by commas."""
    return joined(F.transform(F.filter(verdicts, lambda v: v["status"] == "match"), lambda v: v["term"]))


def groups(verdicts: Column) -> Column:
    """Groups of the matched terms, sorted, separated by commas."""
    return joined(F.transform(F.filter(verdicts, lambda v: v["status"] == "match"), lambda v: v["grp"]))


def mixed(verdicts: Column, tokens: Column, markers: Iterable[str]) -> Column:
    """Whether a text that matches also has a guarded mention or a token that begins with a marker."""
    markers = tuple(markers)
    matched = F.exists(verdicts, lambda v: v["status"] == "match")
    guarded = F.exists(verdicts, lambda v: v["guarded"] | (v["status"] == "excluded"))
    marked = F.exists(tokens, lambda t: W.starts_with_any(t, markers)) if markers else F.lit(False)
    return matched & (guarded | marked)


def without_mixed(df: DataFrame, mixed_col: str = "mixed") -> DataFrame:
    """The rows that aren't mixed; null counts as not mixed."""
    return df.filter(~F.coalesce(F.col(mixed_col), F.lit(False)))


def exclusion_report(df: DataFrame, id_col: str, examples: int = 8) -> DataFrame:
    """``term, guard, n, first_ids`` of what the guards rejected: counts and the first ids in order.

    The examples come from a row number per (term, guard); Spark keeps only the
    first of each task before the shuffle (WindowGroupLimit), so a guard with a
    third of all rows sends no more than its examples.
    """
    rejected = df.select(F.col(id_col).alias("_id"), F.explode("verdicts").alias("v")).filter("v.status = 'excluded'").select("_id", "v.term", "v.guard")
    counts = rejected.groupBy("term", "guard").agg(F.count("*").alias("n"))
    order = Window.partitionBy("term", "guard").orderBy("_id")
    first = rejected.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= examples)
    listed = first.groupBy("term", "guard").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_id")), lambda x: x.cast("string")), ",").alias("first_ids"))
    return counts.join(listed, ["term", "guard"])

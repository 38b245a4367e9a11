"""Personal data: format rules, and candidate spans picked by boosted trees.

Native: every text is scanned by column expressions only. The rules give the
base spans. High-recall generators propose spans that may overlap; those that
touch a base span are left out, boosted trees over format and context features
score the others, and a threshold calibrated for each kind selects what is
added.

The labels are independent of the rules: examples of known truth, personal data
and secrets as well as look-alikes (order numbers, versions, digests), are
planted into stretches of the corpus' own texts. The trees are fitted on the
driver to a bounded number of them and become one CASE expression.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterlake.llm.common import thinned

KINDS = ("email", "ip", "card", "phone")

#: The rules' patterns. They are written so that no run of
#: characters is scanned twice and no match recurses; they match the same spans as
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: [0-9]([\x20-]?[0-9])+
#: \+[0-9][\x20().0-9-]+[0-9]
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this holds no span of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Kinds of added spans, in the order of the output; secrets are never found by a rule.
ADDED_KINDS = (*KINDS, "secret")
#: High-recall proposals, (kind, pattern, what a text must match to be scanned): other
#: alphabets and spellings, spans inside longer runs of digits, other prefixes, tokens.
GENERATORS = (
    ("email", r"[^\s@<>()\[\],;:\x22\x27]{1,64}+@[^\s@<>()\[\],;:\x22\x27]{1,255}+", "@"),
    ("email", r"(?i)[\p{L}\p{N}._%+-]{1,64}+ ?[(\[{] ?at ?[)\]}] ?[\p{L}\p{N}-]{1,63}+(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[\p{L}\p{N}-]{1,63}+){1,4}+", r"(?i)[(\[{] ?at ?[)\]}]"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}", r"[0-9]\.[0-9]"),
    ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}+(?::{1,2}+[0-9A-Fa-f]{1,4}+){2,7}+(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{1,4}:"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{2,7}(?![0-9])", "[0-9]{4}"),
    ("card", r"(?<![0-9])3[47][0-9]{2}[\x20.-]?[0-9]{6}[\x20.-]?[0-9]{5}(?![0-9])", "3[47][0-9]{2}"),
    ("phone", r"(?:\+|(?<![0-9])00)[1-9][0-9]{0,2}(?:[\x20().-]{0,2}[0-9]){7,14}(?![0-9])", r"\+|00[1-9]"),
    ("phone", r"(?<![0-9+(.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,5}(?![0-9])", r"[0-9][)]?[\x20./-]{1,2}[0-9]{3}"),
    ("secret", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,256}+(?![A-Za-z0-9_/+-])", "[0-9]"),
    ("secret", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s:,.-]{0,8192}?-----END [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY-----"),
    ("secret", r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)[\x22\x27]?\s?[=:]\s?[\x22\x27]?[^\s\x22\x27,;]{6,128}+", r"[dtnyDTNY][\x22\x27]?\s?[=:]"),
)
#: A text without this has no candidate of any generator.
ANY = r"[0-9@]|PRIVATE KEY-----|[(\[{] ?[aA][tT] ?[)\]}]|[dtnyDTNY][\x22\x27]?\s?[=:]"
#: Words before a span that speak of personal data or of a secret, and words that speak of something else.
CUES = {
    "email": "(?i)(?:e-?mail|mail|contact|write|kontakt|correo|courriel|adresse)",
    "ip": "(?i)(?:\\bip|address|host|server|adresse|login from)",
    "card": "(?i)(?:card|visa|credit|paid|karte|tarjeta|carte)",
    "phone": "(?i)(?:tel|phone|call|fax|mobile|kontakt|numero)",
    "secret": "(?i)(?:password|passwd|pwd|secret|token|key|credential|auth|bearer)",
}
OTHER = "(?i)(?:order|invoice|version|release|build|commit|isbn|article|part|file|image|serial|batch|ratio|time|total|id|sha|md5|chapter)"
KNOWN_SECRET = r"^(?:-----BEGIN |AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_][A-Za-z0-9_-]{16,}|xox[abp]-.{10,}|AIza[A-Za-z0-9_-]{20,}|glpat-[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{16,})"
#: An assignment: by an equals sign, or by a colon before what no sentence goes on with.
ASSIGNED = r"(?i)^(?:password|passwd|pwd|secret|token|api[_-]?key)[\x22\x27]?\s?(?:=|:(?=\s?[\x22\x27]?(?:\S*[0-9!@#$%^&*_]|\S{14})))"
NEAR = 24
FOUND = "array<struct<start:int,`end`:int,text:string>>"
ADDED = "array<struct<start:int,`end`:int,kind:int>>"
CANDIDATES = "array<struct<start:int,`end`:int,kind:int,x:array<double>>>"
CHUNK = 512
#: Code points of a piece of a text: what surrounds a span is read from its pieces, not by counting from the text's start.
PIECE = 1024

#: Bounds of the training sample: stretches of texts, and planted examples.
MAX_DOCS = 2_000
MAX_CANDIDATES = 8_000
STRETCH = 60
PRECISION = 0.99
FEATURES = (
    "is_email", "is_ip", "is_card", "is_phone", "is_secret", "n_chars", "n_digits", "n_upper", "n_lower", "n_marks", "n_distinct",
    "valid", "prefix", "open_left", "open_right", "cue", "other",
)


def _quoted(pattern: str) -> str:
    """A pattern as a raw SQL literal; quotes in patterns are written by their codes."""
    if "'" in pattern:
        raise ValueError("write a quote as \\x27")
    return f"r'{pattern}'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


# Expressions over texts are put together as SQL: they are long, and each call to the JVM for a column costs a millisecond.
def located(text: str, pattern: str) -> str:
    """array<struct<start, end, text>> of the matches from left to right, in code points.

    What ``split`` leaves between the matches gives their places. Running
    totals are taken in chunks, so that thousands of matches in one text do
    not make it quadratic.
    """
    p = _quoted(pattern)
    steps = f"filter(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (gap, m) -> named_struct('gap', length(gap), 'text', m)), x -> x.text IS NOT NULL)"
    found = "named_struct('start', acc.at + x.gap, 'end', acc.at + x.gap + length(x.text), 'text', x.text)"
    total = f"""aggregate(slice(s, c * {CHUNK} + 1, {CHUNK}), named_struct('at', 0, 'out', CAST(array() AS {FOUND})),
        (acc, x) -> named_struct('at', acc.at + x.gap + length(x.text), 'out', concat(acc.out, array({found}))))"""
    chunks = f"transform(sequence(0, greatest(CAST(ceil(size(s) / {CHUNK}) AS INT) - 1, 0)), c -> {total})"
    bases = "aggregate(parts, array(0), (acc, p) -> concat(acc, array(element_at(acc, -1) + p.at)))"
    moved = "transform(p.out, x -> named_struct('start', x.start + base, 'end', x.`end` + base, 'text', x.text))"
    placed = f"flatten(filter(zip_with(parts, {bases}, (p, base) -> {moved}), x -> x IS NOT NULL))"
    return _let(_let(steps, "s", chunks), "parts", placed)


def pieces(text: str) -> str:
    """The text in pieces of PIECE code points, for ``between``."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{PIECE}}}', 0)"


def between(parts: str, start: str, end: str) -> str:
    """Code points ``start`` to ``end`` (exclusive) of a text in ``pieces``, in time that only their number counts for."""
    first, last = f"CAST(floor(({start}) / {PIECE}) AS INT)", f"CAST(floor(({end} - 1) / {PIECE}) AS INT)"
    return f"CASE WHEN {end} <= {start} THEN '' ELSE substr(array_join(slice({parts}, {first} + 1, {last} - {first} + 1), ''), ({start}) % {PIECE} + 1, {end} - ({start})) END"


def scanned(items: str, kind: str, begin: str, step: str, out: str = "out") -> str:
    """Folds an array from left to right and gives the array that the steps have put out, in linear time.

    ``begin`` is the state, a struct with the empty array ``out`` of the given
    type; ``step`` the next state from ``a`` (the state) and ``x`` (the item).
    Arrays grow within chunks only, and chunks are flattened at the end.
    """
    fold = f"aggregate(slice(s, c * {CHUNK} + 1, {CHUNK}), named_struct('at', whole.at, 'out', CAST(array() AS {kind})), (a, x) -> {step})"
    keep = _let(fold, "part", "named_struct('at', part.at, 'parts', concat(whole.parts, array(part.out)))")
    chunks = f"sequence(0, greatest(CAST(ceil(size(s) / {CHUNK}) AS INT) - 1, 0))"
    return _let(items, "s", f"aggregate({chunks}, named_struct('at', {begin}, 'parts', CAST(array() AS array<{kind}>)), (whole, c) -> {keep}, whole -> flatten(whole.parts))")


def outside(found: str, ruled: str) -> str:
    """The spans of ``found`` that overlap none of ``ruled``: one sort and one scan.

    At a span's end, the farthest end of the ruled spans that have begun before tells.
    """
    none = f"CAST(NULL AS {FOUND[6:-1]})"
    begun = f"transform({ruled}, r -> named_struct('pos', r.start, 'rule', 1, 'far', r.`end`, 'x', {none}))"
    asked = f"transform(filter({found}, x -> x.start < x.`end`), x -> named_struct('pos', x.`end`, 'rule', 0, 'far', 0, 'x', x))"
    step = "CASE WHEN x.rule = 1 THEN named_struct('at', greatest(a.at, x.far), 'out', a.out) WHEN a.at > x.x.start THEN a ELSE named_struct('at', a.at, 'out', concat(a.out, array(x.x))) END"
    return f"CASE WHEN size({ruled}) = 0 THEN filter({found}, x -> x.start < x.`end`) ELSE {scanned(f'array_sort(concat({begun}, {asked}))', FOUND, '0', step)} END"


def valid(kind: str, text: str) -> str:
    """Whether a match of the rule's pattern passes the rule."""
    if kind == "email":
        return "true"
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return f"{text} rlike " + _quoted(rf"^{part}\.{part}\.{part}\.{part}$")
    digits = f"regexp_replace({text}, '[^0-9]', '')"
    if kind == "card":
        d = "CAST(substr(d, length(d) - i + 1, 1) AS INT)"
        luhn = f"aggregate(sequence(1, length(d)), 0, (acc, i) -> acc + CASE WHEN i % 2 = 1 THEN {d} WHEN {d} > 4 THEN {d} * 2 - 9 ELSE {d} * 2 END) % 10 = 0"
        return f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {_let(digits, 'd', luhn)} ELSE false END"
    return f"length({digits}) BETWEEN 10 AND 15"


def rule_spans(text: str, kind: str) -> str:
    """The spans that the rules accept, array<struct<start, end, text>>."""
    needed = f"contains({text}, '{NEEDS[kind]}')" if NEEDS[kind] else f"{text} rlike '[0-9]'"
    return f"coalesce(CASE WHEN {needed} THEN filter({located(text, RULES[kind])}, x -> {valid(kind, 'x.text')}) END, CAST(array() AS {FOUND}))"


def _passes(kind: str, span: str) -> str:
    """Whether a candidate has the checkable form of its kind."""
    if kind == "email":
        return f"{span} rlike " + _quoted(r"(?i)^[^@]+(?:@| ?[(\[{] ?at ?[)\]}] ?)[^@]+(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[\p{L}]{2,}$")
    if kind == "ip":
        return f"({valid('ip', span)} OR {span} rlike '^(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$' OR (contains({span}, '::') AND length({span}) > 6))"
    if kind == "secret":
        return f"({span} rlike {_quoted(KNOWN_SECRET)} OR {span} rlike {_quoted(ASSIGNED)})"
    return valid(kind, span)


def candidates(text: str, generator: tuple[str, str, str], ruled: str, parts: str) -> str:
    """The generator's spans outside ``ruled`` as CANDIDATES, their features in the order of FEATURES."""
    kind, pattern, needs = generator
    counted = lambda other: f"length(regexp_replace(x.text, {_quoted(other)}, ''))"
    before = between(parts, f"greatest(x.start - {NEAR}, 0)", "x.start")
    like = lambda what, where: f"{what} rlike {_quoted(where)}"
    values = [
        *(str(kind == k) for k in ADDED_KINDS),
        "length(x.text)", counted("[^0-9]"), counted("[^A-Z]"), counted("[^a-z]"), counted(r"[\p{L}\p{N}]"),
        "size(array_distinct(split(x.text, '')))", _passes(kind, "x.text"), like("x.text", r"^(?:\+|\(?0)"),
        like("b", r"[\p{L}\p{N}]$"), like(f"substr(get({parts}, CAST(floor(x.`end` / {PIECE}) AS INT)), x.`end` % {PIECE} + 1, 1)", r"^[\p{L}\p{N}]"), like("b", CUES[kind]), like("b", OTHER),
    ]
    x = _let(before, "b", f"array({', '.join(f'CAST({v} AS DOUBLE)' for v in values)})")
    described = f"named_struct('start', x.start, 'end', x.`end`, 'kind', {ADDED_KINDS.index(kind)}, 'x', {x})"
    return f"coalesce(CASE WHEN {like(text, needs)} THEN transform({_let(located(text, pattern), 'found', outside('found', ruled))}, x -> {described}) END, CAST(array() AS {CANDIDATES}))"


def all_candidates(text: str) -> Column:
    """Those of all generators, outside the spans of the rules, which stand under their reserved names."""
    ruled = "concat(" + ", ".join(f"transform(`__{k}`, s -> named_struct('start', s.start, 'end', s.`end`))" for k in KINDS) + ")"
    every = _let(ruled, "ruled", _let(pieces(text), "p", f"concat({', '.join(candidates(text, g, 'ruled', 'p') for g in GENERATORS)})"))
    return F.expr(f"coalesce(CASE WHEN {text} rlike {_quoted(ANY)} THEN {every} END, CAST(array() AS {CANDIDATES}))")


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


@dataclass(frozen=True)
class Boosted:
    """A sum of trees, in log odds, and the score from which a candidate of each kind is taken (None: never)."""

    base: float
    trees: tuple
    thresholds: tuple

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_predict(t, x) for t in self.trees), np.zeros(len(x)))

    def expression(self, x: str) -> str:
        """The margin as SQL over an array of features."""
        return " + ".join([f"{self.base!r}D", *(_expression(t, x) for t in self.trees)])


def _predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at, _predict(tree.low, x), _predict(tree.high, x))


def _expression(tree, x: str) -> str:
    if isinstance(tree, Leaf):
        return f"{tree.value!r}D"
    return f"CASE WHEN get({x}, {tree.feature}) <= {tree.at!r}D THEN {_expression(tree.low, x)} ELSE {_expression(tree.high, x)} END"


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, shrink: float):
    """A tree by the second-order gain, splits halfway between neighbouring values."""
    best = (1e-6, None)
    score = lambda a, b: a * a / (b + 1.0)
    whole = score(g.sum(), h.sum())
    for f in range(x.shape[1]) if depth else ():
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(ch[cut] >= least) & (ch[-1] - ch[cut] >= least)]
        if len(cut):
            gain = score(cg[cut], ch[cut]) + score(cg[-1] - cg[cut], ch[-1] - ch[cut]) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
    if best[1] is None:
        return Leaf(float(-shrink * g.sum() / (h.sum() + 1.0)))
    f, at = best[1]
    low = x[:, f] <= at
    return Split(f, at, _grow(x[low], g[low], h[low], depth - 1, least, shrink), _grow(x[~low], g[~low], h[~low], depth - 1, least, shrink))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, kind: np.ndarray, rounds: int = 30, depth: int = 4, precision: float = PRECISION) -> Boosted:
    """Trees from the rows that aren't ``held``, for each kind a threshold from those that are.

    A threshold is the least score from which on held rows of the kind are
    positive in a share of ``precision``, and never less than the score of even
    odds, by a logistic curve through the held rows; None if there is none.
    """
    tx, ty = x[~held], y[~held].astype(float)
    mean = min(max(ty.mean() if len(ty) else 0.5, 1e-3), 1 - 1e-3)
    base, trees, margin = float(np.log(mean / (1 - mean))), [], np.zeros(len(ty))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(base + margin)))
        trees.append(_grow(tx, p - ty, p * (1 - p), depth, 1.0, 0.3))
        margin += _predict(trees[-1], tx)
    model = Boosted(base, tuple(trees), ())
    thresholds = []
    for k in range(len(ADDED_KINDS)):
        of = held & (kind == k)
        score, truth = model.margin(x[of]), y[of]
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        last = np.append(score[order][1:] < score[order][:-1], True)[: len(order)]  # equal scores go together
        good = np.flatnonzero((right >= precision) & last)
        if not len(good):
            thresholds.append(None)
            continue
        least, below = score[order][good[-1]], score[order][good[-1] + 1 :]
        if not len(below):
            thresholds.append(float(least - 1e-6))
        else:  # between the two scores: even odds if they lie there, so that a wide gap isn't given away, else the middle
            thresholds.append(0.0 if below[0] < 0 < least else float((least + below[0]) / 2))
        thresholds[-1] = max(thresholds[-1], even_odds(score, truth))
    return Boosted(base, tuple(trees), tuple(thresholds))


def even_odds(score: np.ndarray, truth: np.ndarray) -> float:
    """The score at which a logistic curve through the rows passes one half; a slight prior keeps it near zero."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -35, 35)))
        g, h = p - truth, np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(g * score).sum() + (a - 1), g.sum() + b])
        hessian = np.array([[(h * score * score).sum() + 1, (h * score).sum()], [(h * score).sum(), h.sum() + 1]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(-b / a) if a > 1e-3 else 0.0


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _text(column: str) -> str:
    return f"coalesce(`{column.replace('`', '``')}`, '')"


def _ruled(text: str) -> list[Column]:
    return [F.expr(rule_spans(text, k)).alias(f"__{k}") for k in KINDS]


LETTERS = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"


def planted(rng: random.Random, kind: str) -> tuple[str, str, bool]:
    """(words before, span, truth): one example of a kind, or a look-alike."""
    some = lambda letters, low, high=None: "".join(rng.choice(letters) for _ in range(rng.randint(low, high or low)))
    word = lambda: some(LETTERS, 3, 9)
    mixed, hexes = LETTERS + LETTERS.upper() + DIGITS, DIGITS + "abcdef"
    truth = rng.random() < 0.5

    def numbered(n: int, right: bool) -> str:
        digits = rng.choice("3456") + some(DIGITS, n - 2)
        total = sum(int(c) * (2 - i % 2) - 9 * (int(c) > 4 and i % 2 == 0) for i, c in enumerate(reversed(digits)))
        check = -total % 10
        return digits + str(check if right else (check + rng.randint(1, 9)) % 10)

    if kind == "email":
        at, dot = rng.choice([(" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", ".")])
        good = [lambda: f"{word()}.{word()}{at}{word()}{dot}{rng.choice(['org', 'com', 'net', 'de', 'fr', 'es'])}", lambda: f"{word()}ü{word()}@{word()}ä{word()}.{rng.choice(['de', 'com', 'org'])}"]
        bad = [lambda: f"{some(DIGITS, 1, 2)}@{some(DIGITS, 1, 2)}.{some(DIGITS, 2)}", lambda: f"{word()}@{word()}", lambda: f"{word()}@{some(DIGITS, 1, 3)}", lambda: f"{word()}[at]{some(DIGITS, 1, 2)}.{some(DIGITS, 1, 2)}"]
        cues, others = ["mail", "e-mail:", "write to", "contact"], ["at", "ratio", "version", "total"]
    elif kind == "ip":
        group = lambda: some(hexes, 4)
        good = [lambda: ":".join(group() for _ in range(8)), lambda: f"{rng.choice(['2001', 'fe80', '2a02'])}:{group()}::{group()}:{group()}"]
        bad = [lambda: ":".join(f"{rng.randint(0, 59):02d}" for _ in range(3)), lambda: ":".join(some(hexes, 2) for _ in range(6)), lambda: f"{rng.randint(1, 9)}:{rng.randint(1, 9)}:{rng.randint(1, 9)}", lambda: f"{rng.randint(1, 20)}.{rng.randint(0, 30)}.{rng.randint(256, 999)}.{rng.randint(256, 999)}"]
        cues, others = ["ip", "address", "host", "login from"], ["time", "ratio", "version", "build"]
    elif kind == "card":
        mark = rng.choice([".", " ", "-", ""])
        cut = lambda d: mark.join(d[i : i + 4] for i in range(0, len(d), 4))
        # the neighbouring digits keep the rule from a match
        run = lambda d: f"{some(DIGITS, 1)} {d}" if mark != "." else d
        good = [lambda: run(cut(numbered(16, True)))]
        bad = [lambda: cut(numbered(16, False)), lambda: run(cut(numbered(16, False))), lambda: f"20{some(DIGITS, 12)}"]
        cues, others = ["card", "visa", "paid with", "credit"], ["order", "invoice", "serial", "batch"]
    elif kind == "phone":
        good = [lambda: f"00{rng.randint(1, 99)} {rng.randint(10, 999)} {some(DIGITS, 6, 8)}", lambda: f"({rng.randint(200, 999)}) {some(DIGITS, 3)}-{some(DIGITS, 4)}", lambda: f"{rng.randint(200, 999)}-{some(DIGITS, 3)}-{some(DIGITS, 4)}", lambda: f"0{some(DIGITS, 2, 4)}/{some(DIGITS, 3)}{some(DIGITS, 3, 5)}"]
        bad = [lambda: f"{rng.randint(10, 99)} {some(DIGITS, 3)} {some(DIGITS, 3)}", lambda: f"{rng.randint(1000, 9999)}-{some(DIGITS, 4)}{some(DIGITS, 3)}", lambda: f"{rng.randint(10, 99)}.{some(DIGITS, 3)}.{some(DIGITS, 3)}", lambda: f"19{some(DIGITS, 2)}-{some(DIGITS, 4)} {some(DIGITS, 3)}"]
        cues, others = ["call", "phone", "tel.", "fax:"], ["total", "isbn", "article", "part"]
    else:
        good = [
            lambda: "AKIA" + some(LETTERS.upper() + DIGITS, 16), lambda: "ghp_" + some(mixed, 36), lambda: "sk-" + some(mixed, 32, 48),
            lambda: f"{rng.choice(['password', 'secret', 'token', 'api_key'])}{rng.choice(['=', ': '])}{some(mixed, 5, 20)}{some(DIGITS, 1, 3)}", lambda: some(mixed, 30, 40) + some(DIGITS, 1),
            lambda: f"{rng.choice(['password', 'secret', 'token'])}{rng.choice(['=', ' = '])}{some(LETTERS, 6, 12)}", lambda: f"{rng.choice(['password', 'secret'])}: {some(LETTERS, 15, 24)}",
            lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{some(mixed, 64)}\n{some(mixed, 64)}\n-----END RSA PRIVATE KEY-----",
        ]
        bad = [
            lambda: f"{word()}_{word()}_{some(DIGITS, 1, 4)}_{word()}", lambda: f"{word()}-{word()}-20{some(DIGITS, 2)}-{some(DIGITS, 2)}-{some(DIGITS, 2)}", lambda: f"IMG_20{some(DIGITS, 6)}_{some(DIGITS, 6)}",
            lambda: f"{rng.choice(['password', 'secret', 'token'])}: {some(LETTERS, 6, 10)}", lambda: some(hexes, 40), lambda: f"{some(hexes, 8)}-{some(hexes, 4)}-{some(hexes, 4)}-{some(hexes, 12)}",
            lambda: some(DIGITS, 16, 24), lambda: f"{word()}{word()}{word()}{some(DIGITS, 1, 2)}",
        ]
        cues, others = ["key", "token", "credential", "auth"], ["commit", "file", "image", "sha"]
    span = rng.choice(good if truth else bad)()
    drawn = rng.random()
    before = rng.choice(cues if truth else others) if drawn < 0.4 else rng.choice(others if truth else cues) if drawn < 0.45 else ""
    return before, span, truth


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_candidates: int = MAX_CANDIDATES, seed: int = 3) -> Boosted:
    """Trees from ``max_candidates`` planted examples in stretches of at most ``max_docs`` texts, drawn by a hash of the row.

    A stretch has at most 2 x STRETCH code points, whatever the text's length.
    Null and empty texts give empty stretches. No rows: examples stand alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.xxhash64(F.lit(seed), F.col(id_col), text)
    middle = F.pmod(order, F.greatest(F.length(text) - 2 * STRETCH, F.lit(1)).cast("long")).cast("int")
    drawn = thinned(docs.withColumn("__order", F.xxhash64(F.lit(seed), F.col(id_col))), "__order", max_docs)
    drawn = drawn.select(order.alias("o"), F.substr(text, middle + 1, F.lit(2 * STRETCH)).alias("t"))
    around = [r["t"] for r in drawn.orderBy("o", "t").limit(max_docs).collect()] or [""]
    rng, rows = random.Random(seed), []
    for n in range(max_candidates):
        kind = n % len(ADDED_KINDS)
        before, span, truth = planted(rng, ADDED_KINDS[kind])
        stretch = rng.choice(around)
        left = f"{stretch[:STRETCH].rsplit(' ', 1)[0]} {before} ".replace("  ", " ")
        rows.append((n, kind, truth, len(left), len(left) + len(span), f"{left}{span} {stretch[STRETCH:].partition(' ')[2]}"))
    examples = docs.sparkSession.createDataFrame(rows, "n int, kind int, truth boolean, a int, b int, t string")
    met = examples.select("*", *_ruled("t")).select("n", "kind", "truth", "a", "b", F.explode(all_candidates("t")).alias("c"))
    met = met.where((F.col("c.start") < F.col("b")) & (F.col("a") < F.col("c.end")))
    got = met.select("n", "kind", "truth", F.col("c.kind").alias("k"), F.col("c.x").alias("x")).toPandas()
    got = got.assign(x=got["x"].map(tuple)).sort_values(["n", "k", "x"])
    x = np.array(got["x"].to_list()).reshape(-1, len(FEATURES))
    k = got["k"].to_numpy(np.int64)
    # a candidate of another kind than the plant's is none of that kind
    y = got["truth"].to_numpy(bool) & (k == got["kind"].to_numpy())
    return fit(x, y, got["n"].to_numpy() % 4 == 0, k)


def find_personal_data(docs: DataFrame, model: Boosted | None, text_col: str = "text") -> DataFrame:
    """``docs`` with __email, __ip, __card, __phone (spans of the rules) and __added.

    Spans are array<struct<start, end, text>>, in code points, end exclusive;
    __added is array<struct<start, end, kind>>, kinds numbered as in
    ADDED_KINDS: the candidates that the model takes, in order, outside the
    spans of the rules and of each other (the first of a place stays). Without
    a model nothing is added.

    Null and empty texts have no spans. Repeated rows and ids each return a
    row. No rows: no rows. All columns stay; input columns under the five names
    above, and __candidates, are replaced.
    """
    docs = docs.drop(*(f"__{k}" for k in KINDS), "__added", "__candidates")
    text = _text(text_col)
    rows = docs.select("*", *_ruled(text))
    if model is None:
        return rows.withColumn("__added", F.expr(f"CAST(array() AS {ADDED})"))
    rows = rows.withColumn("__candidates", all_candidates(text))
    least = ", ".join("CAST(NULL AS DOUBLE)" if t is None else f"{t!r}D" for t in model.thresholds)
    taken = f"transform(filter(__candidates, c -> {model.expression('c.x')} >= get(array({least}), c.kind)), c -> named_struct('start', c.start, 'end', c.`end`, 'kind', c.kind))"
    apart = "CASE WHEN a.at > x.start THEN a ELSE named_struct('at', x.`end`, 'out', concat(a.out, array(x))) END"
    added = F.expr(scanned(f"array_sort({taken})", ADDED, "0", apart))
    return rows.withColumn("__added", added).drop("__candidates")


def all_spans(with_added: bool) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    spans = [_tagged(F.col(f"__{k}"), n) for n, k in enumerate(KINDS)]
    if with_added:
        spans.append(F.col("__added"))
    ordered = F.array_sort(F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*(F.lit(k) for k in ADDED_KINDS))
    line = F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(line, ",")


def redact(docs: DataFrame, model: Boosted | None, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by its kind in brackets; where spans overlap, the first.

    Spans that begin together count in the order of their kinds, rules first.
    Null texts become empty ones; texts without spans stay as they are.
    Repeated rows each return a row, no rows none; all columns stay.
    """
    rows = find_personal_data(docs, model, text_col)
    spans = ", ".join(f"transform(`__{k}`, s -> named_struct('start', s.start, 'end', s.`end`, 'kind', {n}))" for n, k in enumerate(KINDS))
    ordered = f"array_sort(transform(concat({spans}, __added), s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.`end`)))"
    names = "array(" + ", ".join(f"'[{k}]'" for k in ADDED_KINDS) + ")"
    keep = between("p", "a.at", "x.start")
    step = f"CASE WHEN x.start < a.at THEN a ELSE named_struct('at', x.`end`, 'out', concat(a.out, array(named_struct('end', x.`end`, 'text', concat({keep}, get({names}, x.kind)))))) END"
    cut = scanned(ordered, "array<struct<`end`:int,text:string>>", "0", step)
    text = _text(text_col)
    rest = between("p", "coalesce(try_element_at(cut, -1).`end`, 0)", f"length({text})")
    whole = _let(pieces(text), "p", _let(cut, "cut", f"concat(array_join(transform(cut, x -> x.text), ''), {rest})"))
    return rows.withColumn(text_col, F.expr(whole)).select(*(F.col(f"`{c}`") for c in docs.columns))

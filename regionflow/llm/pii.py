"""Personal data by candidate gradient boosting, in built-in expressions only.

1. Base rules find emails, IP addresses, card and phone numbers.
2. High-recall generators propose more, overlapping spans: looser addresses, dotted numbers, long number runs.
3. Each candidate gets format and context features, all of them small codes, so training data of any size is a
   table of cells: how many candidates have these codes and are personal data. One aggregation makes it.
4. What may be added is just what no base rule matches, so base spans cannot label it. ``labelled_sample`` writes a
   bounded sample of short texts, the same for every corpus, whose one value is known to be personal data or not.
   Boosted trees of depth two are grown on its cells, and their scores calibrated by isotonic regression on a
   held-out fold. The lowest score whose calibrated precision is high enough is the threshold. The precision is that
   of the sample; of a corpus nobody has labelled it is not known.
5. The trees become a ``CASE`` expression that scores every candidate where it stands. Selected candidates join the
   base spans; base spans always stay.

Texts are read once and never shuffled.
"""
from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import stored, whole_text

_SPLIT, _OTHER = "\u0001", "\u0002"

# The base patterns, in their order. Possessive forms and the look-behind only spare the matcher vain
# work on long runs; what they match is the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Generators of candidates, by the kind they propose.
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?(?:\(at\)|\[at\])\x20?|@)[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3,}+",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20.-]?[0-9]){11,}+",
    "phone": r"(?:\G|(?<![0-9+]))\+?+\(?+[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
}
#: Words before a value that speak for its kind, and words that speak against any.
CUES = {
    "email": r"e-?mail|mail|contact|kontakt|courriel|correo|write to|reach",
    "ip": r"host|server|ip|addr|address|login",
    "card": r"card|visa|mastercard|amex|credit|debit|pay|karte|kreditkarte|carte|tarjeta",
    "phone": r"tel|telephone|telefon|téléphone|teléfono|phone|call|dial|fax|cell|mobile|mobil|handy|whatsapp|sms|contact|kontakt",
}
AGAINST = (r"order|invoice|isbn|issn|version|serial|build|sku|article|item|ref|reference|tracking|parcel|id|ticket|case|"
           r"model|part|page|timestamp|date|total|amount|sum|zip|iban|hash|token|bestellung|rechnung|commande|facture|pedido|factura")
#: Characters of context looked at on each side.
CONTEXT = 24

SPANS = "array<struct<kind:string,start:int,end:int>>"


def _text(column: Column) -> Column:
    """The text without the separator character; lengths and matches stay as they are."""
    return F.translate(whole_text(column), _SPLIT, _OTHER)


def _pieces(text: Column, pattern: str) -> Column:
    """Alternately what stands before a match and the match; NULL without a match."""
    return F.when(F.rlike(text, F.lit(pattern)),
                  F.split(F.regexp_replace(text, pattern, f"{_SPLIT}$0{_SPLIT}"), _SPLIT))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, k: total + F.when(
        k % 2 == 1, F.substring(digits, -k, F.lit(1)).cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                     F.substring(digits, -k, F.lit(1)).cast("int") + 1)))
    return (F.length(digits) > 0) & (F.when(F.length(digits) > 0, total).otherwise(1) % 10 == 0)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return F.rlike(match, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(F.when(F.length(digits).between(16, 19), digits).otherwise(""))
    return F.length(digits).between(8, 15)


def _places(pieces: Column, keep) -> Column:
    """Indices (1-based) of the matches among ``pieces`` for which ``keep(match)`` holds."""
    odd = F.when(F.size(pieces) > 1, F.sequence(F.lit(2), F.size(pieces), F.lit(2)))
    return F.filter(odd, lambda i: keep(F.element_at(pieces, i)))


def _start(pieces: Column, i: Column) -> Column:
    return F.aggregate(F.slice(pieces, F.lit(1), i - 1), F.lit(0), lambda total, piece: total + F.length(piece))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _base_spans(pieces: dict[str, Column]) -> Column:
    """All base spans by kind as listed, then start."""
    def of(kind: str, own: Column) -> Column:
        spans = F.transform(_places(own, lambda match: _valid(kind, match)), lambda i: F.struct(
            F.lit(kind).alias("kind"), _start(own, i).alias("start"),
            (_start(own, i) + F.length(F.element_at(own, i))).alias("end")))
        return F.coalesce(spans, _none(SPANS))

    return F.concat(*[of(kind, pieces[kind]) for kind in KINDS])


#: Codes of each feature: the size of the cell table is bounded by their product, whatever the corpus. ``plus`` is a
#: leading plus, of addresses that no space stands inside; ``cue`` is 0 against, 1 nothing, 2 a word of the own kind.
FEATURES = {"kind": 4, "digits": 6, "groups": 4, "plus": 2, "check": 2, "tail": 3, "cue": 3, "glued": 2}
_CANDIDATES = "array<struct<kind:int,start:int,end:int," + ",".join(f"{k}:int" for k in list(FEATURES)[1:]) + ">>"


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _says(near: Column, words: str) -> Column:
    return F.rlike(near, F.lit(rf"(?iu)(?<!\p{{L}})(?:{words})(?!\p{{L}})"))


def _layout(kind: str, match: Column, count: Column) -> Column:
    """How a value is written; 3 if the format itself speaks for the kind: card groups, an address without spaces or
    with its dot spelt."""
    if kind == "email":
        spelt = F.rlike(match, F.lit(r"[(\[]dot[)\]]"))
        dotted = spelt | F.contains(match, F.lit("."))
        return F.when(spelt | dotted & ~F.contains(match, F.lit(" ")), 3).when(dotted, 1).otherwise(0)
    if kind == "card":
        grouped = r"^[0-9]{4}([\x20.-])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{6}\1[0-9]{4,5})$"
        return F.when(F.rlike(match, F.lit(grouped)), 3).when(F.length(match) > count, 1).otherwise(0)
    return F.least(F.length(match) - count, F.lit(2))


def _formed(kind: str, match: Column, digits: Column, count: Column) -> Column:
    """Whether a value can be of its kind at all, in whatever format."""
    if kind == "email":
        return F.rlike(match, F.lit(r"^[^@(\[]*[A-Za-z]")) & F.rlike(match, F.lit(r"(?:\.|[(\[]dot[)\]]\x20?)[A-Za-z]{2,}$"))
    if kind == "ip":
        return _valid("ip", match)
    if kind == "card":
        fits = count.between(13, 19)
        return fits & _luhn(F.when(fits, digits).otherwise(""))
    date = r"(?:19|20)[0-9]{2}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2}"
    other = rf"^(?:{date})|^[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}$|^[0-9]+\.[0-9]+$"
    return count.between(7, 15) & ~F.rlike(match, F.lit(other))


def _candidates(pieces: dict[str, Column]) -> Column:
    """Proposed spans with their feature codes."""
    def of(code: int, kind: str, own: Column) -> Column:
        def described(i):
            match = F.element_at(own, i)
            before, after = F.element_at(own, i - 1), F.element_at(own, i + 1)
            digits, count = _digits(match), F.length(_digits(match))
            steps = {"email": (1, 3, 6, 9, 12), "ip": (4, 6, 8, 10, 12), "card": (13, 15, 16, 19, 20),
                     "phone": (8, 10, 12, 14, 16)}[kind]
            bucket = sum((_flag(count >= step) for step in steps[1:]), _flag(count >= steps[0]))
            tail = F.when(F.rlike(after, F.lit(r"^[\p{L}0-9]")), 2).when(F.rlike(after, F.lit(r"^[.,;:)]")), 1).otherwise(0)
            near = F.right(before, F.lit(CONTEXT))
            near = F.when(F.length(before) > CONTEXT, F.regexp_replace(near, r"^\p{L}+", "")).otherwise(near)
            cue = F.when(_says(near, AGAINST), 0).when(_says(near, CUES[kind]), 2).otherwise(1)
            return F.struct(
                F.lit(code).alias("kind"), _start(own, i).alias("start"),
                (_start(own, i) + F.length(match)).alias("end"), bucket.alias("digits"),
                _layout(kind, match, count).alias("groups"),
                _flag(~F.contains(match, F.lit(" ")) if kind == "email" else F.startswith(match, F.lit("+"))).alias("plus"),
                _flag(_formed(kind, match, digits, count)).alias("check"), tail.alias("tail"), cue.alias("cue"),
                _flag(F.rlike(before, F.lit(r"[\p{L}0-9]$"))).alias("glued"))

        return F.coalesce(F.transform(_places(own, lambda match: F.lit(True)), described), _none(_CANDIDATES))

    return F.concat(*[of(code, kind, pieces[kind]) for code, kind in enumerate(KINDS)])


@dataclass(frozen=True)
class Tree:
    """Depth two: a test, then one test and two leaf values on either side. A test is (feature, value): code >= value."""

    test: tuple[str, int]
    yes: tuple[tuple[str, int], float, float]
    no: tuple[tuple[str, int], float, float]


@dataclass(frozen=True)
class Boosted:
    """Sum of trees, and the least score per kind from which a candidate is redacted (infinite: never)."""

    bias: float
    trees: tuple[Tree, ...]
    least: tuple[float, ...]

    def score(self, code) -> Column:
        """``code(feature)`` is a column of the feature's code."""
        total = F.lit(self.bias)
        for tree in self.trees:
            def side(part):
                (name, value), yes, no = part
                return F.when(code(name) >= value, F.lit(yes)).otherwise(F.lit(no))
            total = total + F.when(code(tree.test[0]) >= tree.test[1], side(tree.yes)).otherwise(side(tree.no))
        return total


def _grow(cells, rounds: int, rate: float, smooth: float):
    """Boosted trees on cells ``(codes, positive, negative)``; second-order leaf values."""
    tests = [(name, value) for name, codes in FEATURES.items() for value in range(1, codes)]
    names = list(FEATURES)
    at = {name: k for k, name in enumerate(names)}
    positive, all_ = sum(c[1] for c in cells), sum(c[1] + c[2] for c in cells)
    bias = math.log((positive + 1) / (all_ - positive + 1))
    scores, trees = [bias] * len(cells), []

    def split(rows, grads, hess):
        """Best test of these rows: (gain, test, value where it holds, value elsewhere)."""
        g, h = sum(grads[r] for r in rows), sum(hess[r] for r in rows)
        best = (-1.0, tests[0], 0.0, 0.0)
        for name, value in tests:
            k = at[name]
            inside = [r for r in rows if cells[r][0][k] >= value]
            gi, hi = sum(grads[r] for r in inside), sum(hess[r] for r in inside)
            go, ho = g - gi, h - hi
            gain = gi * gi / (hi + smooth) + go * go / (ho + smooth) - g * g / (h + smooth)
            if gain > best[0] + 1e-12:
                best = (gain, (name, value), rate * gi / (hi + smooth), rate * go / (ho + smooth))
        return best

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        grads = [c[1] - (c[1] + c[2]) * q for c, q in zip(cells, p)]
        hess = [(c[1] + c[2]) * q * (1 - q) for c, q in zip(cells, p)]
        top = split(range(len(cells)), grads, hess)[1]
        sides = {flag: [r for r in range(len(cells)) if (cells[r][0][at[top[0]]] >= top[1]) == flag]
                 for flag in (True, False)}
        parts = {flag: split(rows, grads, hess)[1:] for flag, rows in sides.items()}
        trees.append(Tree(top, parts[True], parts[False]))
        for flag, rows in sides.items():
            (name, value), yes, no = parts[flag]
            for r in rows:
                scores[r] += yes if cells[r][0][at[name]] >= value else no
    return bias, tuple(trees)


def _scored(bias: float, trees, codes) -> float:
    at = {name: k for k, name in enumerate(FEATURES)}
    total = bias
    for tree in trees:
        (name, value), yes, no = tree.yes if codes[at[tree.test[0]]] >= tree.test[1] else tree.no
        total += yes if codes[at[name]] >= value else no
    return total


def _threshold(rows, precision: float) -> float:
    """Least score at which isotonic precision (rows: score, positive, negative) reaches ``precision``."""
    steps: list[list[float]] = []  # least score, positives, all; pooled while not increasing
    for score, positive, negative in sorted(rows):
        steps.append([score, positive, positive + negative])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1][1] += last[1]
            steps[-1][2] += last[2]
    return next((s for s, yes, all_ in steps if all_ and yes >= precision * all_), math.inf)


#: Texts of the labelled sample.
SAMPLE_TEXTS = 6_000


def labelled_sample(texts: int = SAMPLE_TEXTS, seed: int = 11) -> list[tuple]:
    """``fold, text, kind, start, end, label``: texts around one value each, written from fixed patterns.

    Personal are: addresses with "(at)" or "[at]" and a top level in letters, with spaces only if "(dot)" is spelt or a
    cue stands before; cards of 13 to 19 digits that pass the Luhn check after a cue, or in card groups without one;
    phones of 7 to 15 digits after a cue. Nothing is personal after a word that speaks against it, inside a longer
    word, with a wrong check digit, as a date or decimal, or (bar the two cases above) without a cue.
    """
    rng = random.Random(seed)
    filler = "the and house river sind nicht Straße werden maison avec être pour casa entre mañana donde 12 7 was.".split()
    cues = {"email": ["email", "E-Mail", "mail", "contact", "Kontakt", "courriel", "correo"],
            "card": ["card", "Visa", "credit card", "Karte", "carte", "tarjeta"],
            "phone": ["tel", "Phone", "call", "fax", "mobile", "Telefon", "téléphone", "teléfono"],
            "ip": ["host", "server", "address"]}
    against = ["order", "invoice", "ISBN", "version", "serial", "tracking", "reference", "id", "Rechnung", "facture", "pedido"]
    number = lambda n: str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))

    def sums(digits):
        return sum(int(c) * (1 + k % 2) - 9 * (int(c) * (1 + k % 2) > 9) for k, c in enumerate(reversed(digits))) % 10

    def card(valid):
        n = rng.choice((13, 14, 15, 16, 16, 16, 19))
        start = number(n - 1)
        digits = start + str(-sums(start + "0") % 10 if valid else (-sums(start + "0") + rng.randint(1, 9)) % 10)
        sep = rng.choice("..- ")
        form = rng.choice(("bare", "groups", "groups", "odd"))
        sizes = {14: (4, 6, 4), 15: (4, 6, 5), 16: (4, 4, 4, 4), 19: (4, 4, 4, 4, 3)}.get(n)
        if form == "groups" and sizes:
            ends = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
            return sep.join(digits[a:b] for a, b in zip(ends, ends[1:])), True
        if form == "odd":
            cut = rng.randint(5, n - 5)
            return digits[:cut] + sep + digits[cut:], False
        return digits, False

    def phone():
        n, sep = rng.randint(7, 15), rng.choice(("", "-", " ", "."))
        digits = number(n)
        form = rng.choice(("bare", "area", "plus", "groups", "groups"))
        if form in ("area", "plus") and n >= 9:
            tail = f"{digits[-6:-3]}-{digits[-3:]}"
            return f"+({digits[:-9] or 1}) {digits[-9:-6]}-{tail}" if form == "plus" else f"({digits[-9:-6]}) {tail}"
        if form == "groups" and sep != ".":
            return sep.join((digits[:3], digits[3:6], digits[6:])) if n > 6 else digits
        return ".".join((digits[:3], digits[3:6], digits[6:])) if form == "groups" else digits

    rows = []
    for k in range(texts):
        kind = rng.choice(("email", "card", "card", "phone", "phone", "ip"))
        said = rng.choice(("cue", "cue", "none", "none", "against", "both", "other"))
        good, shaped = rng.random() < 0.7, False
        if kind == "email":
            at = rng.choice(("(at)", "[at]", " (at) ", " [at] ", "@"))
            dot = rng.choice((".", "(dot)", "[dot]", " (dot) ")) if at != "@" else rng.choice(("(dot)", "[dot]"))
            end = rng.choice(("org", "com", "de", "example")) if good else rng.choice(("", number(2)))
            name = rng.choice(("jane", "j.doe", "info", "max_m", "a1"))
            value = name + at + rng.choice(("example", "mail-7", "uni")) + (dot + end if end else "")
            shaped = " " not in value or "dot" in value
        elif kind == "card":
            value, shaped = card(good)
        elif kind == "phone":
            value = phone() if good else rng.choice((f"20{number(2)}-0{number(1)}-1{number(1)}", f"1{number(1)}.0{number(1)}.20{number(2)}",
                                                     number(16), number(17), f"{number(3)}.{number(8)}", number(20)))
        else:
            value, good = ".".join(rng.choice((number(3), number(1), "999")) for _ in range(4)) + ".300", False
        glued, tail = kind != "email" and rng.random() < 0.12, rng.choice((" ", " ", ". ", ", ", ") ", "; ", *(("x", "f0") if kind != "email" else ())))
        cue = {"cue": rng.choice(cues[kind]), "none": "", "against": rng.choice(against),
               "both": f"{rng.choice(cues[kind])} {rng.choice(against)}",
               "other": "page" if kind == "email" else "host"}[said]
        before = (" ".join(rng.choice(filler[:-3]) for _ in range(rng.randint(2, 5))) + " donde mañana werden " + cue
                  + (rng.choice((" ", ": ", ":", ". ")) if cue else "") + ("b" if glued else ""))
        label = good and not glued and tail[0] not in "xf" and (said == "cue" or shaped and said in ("none", "other") and cue != "page")
        rows.append((int(rng.random() < 0.7), before + value + tail + " ".join(rng.choice(filler[:-3]) for _ in range(4)),
                     kind, len(before), len(before) + len(value), label))
    return rows


def train(candidates: DataFrame, rounds: int = 24, rate: float = 0.5, smooth: float = 1.0,
          precision: float = 0.98) -> Boosted:
    """Grow and calibrate on ``fold`` (0: calibration), ``label`` and the feature codes of labelled candidates."""
    cells = (candidates.groupBy("fold", *FEATURES).agg(
        F.sum(F.col("label").cast("bigint")).alias("positive"), F.count(F.lit(1)).alias("all"))
        .collect())  # at most one row per fold and combination of codes
    cells.sort(key=lambda r: tuple(r))
    grown = [(tuple(r[name] for name in FEATURES), r["positive"], r["all"] - r["positive"]) for r in cells if r["fold"]]
    bias, trees = _grow(grown, rounds, rate, smooth) if grown else (0.0, ())
    held = [(tuple(r[name] for name in FEATURES), r["positive"], r["all"] - r["positive"])
            for r in cells if not r["fold"]]
    least = tuple(_threshold([(_scored(bias, trees, codes), yes, no) for codes, yes, no in held if codes[0] == kind],
                             precision) for kind in range(len(KINDS)))
    return Boosted(bias, trees, least)


def fit(spark) -> Boosted:
    """The model of the labelled sample; a candidate other than the value that a text was written around is none."""
    texts = spark.createDataFrame(labelled_sample(), "fold int, text string, kind string, start int, end int, good boolean")
    wide = texts.select("*", *[_pieces(_text(F.col("text")), GENERATORS[k]).alias(f"g_{k}") for k in KINDS])
    rows = wide.select("fold", "kind", "start", "end", "good",
                       F.explode(_candidates({k: F.col(f"g_{k}") for k in KINDS})).alias("c"))
    of_kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("c.kind") + 1)
    label = F.col("good") & (F.col("c.start") == F.col("start")) & (F.col("c.end") == F.col("end")) & (of_kind == F.col("kind"))
    return train(rows.select("fold", label.alias("label"), "c.*"))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``doc_id, base, spans`` per row of ``docs``: arrays of ``kind, start, end`` in code points, end exclusive.

    ``base`` are the spans of the base rules, by kind as listed, then start. ``spans`` are those and the candidates
    that the boosted trees select and that overlap no base span, by kind, start and end. NULL texts count as empty.
    Rows with NULL or repeated ids each get their row; other columns are left out, whatever their names; an empty
    table gives an empty one.
    """
    clean = docs.select(docs[doc_id].alias("doc_id"), _text(docs[text]).alias("_t"))
    base = {kind: _pieces(F.col("_t"), pattern) for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE))}
    wide = {kind: _pieces(F.col("_t"), GENERATORS[kind]) for kind in KINDS}
    cut = clean.select("doc_id", *[base[k].alias(f"b_{k}") for k in KINDS], *[wide[k].alias(f"g_{k}") for k in KINDS])
    found = stored(cut.select("doc_id", _base_spans({k: F.col(f"b_{k}") for k in KINDS}).alias("base"),
                              _candidates({k: F.col(f"g_{k}") for k in KINDS}).alias("more")))
    kinds = F.array(*map(F.lit, KINDS))
    model = fit(docs.sparkSession)
    least = [F.lit(v) for v in model.least]

    def selected(c):
        bound = F.element_at(F.array(*least), c["kind"] + 1)
        clear = ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return clear & (model.score(lambda name: c[name]) >= bound)

    added = F.transform(F.filter("more", selected), lambda c: F.struct(
        F.element_at(kinds, c["kind"] + 1).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    every = F.array_sort(F.transform(F.concat("base", added), lambda x: F.struct(
        rank[x["kind"]].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    spans = F.transform(every, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select("doc_id", "base", F.when(F.size("more") > 0, spans).otherwise(F.col("base")).alias("spans"))

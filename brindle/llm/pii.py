"""Personal data: candidate spans and gradient-boosted trees over their format and context.

Generators with high recall propose spans, which may overlap: every match of the four base
patterns, obfuscated and spelt-out e-mail addresses, telephone numbers without a plus sign, long
and shortened IP addresses, and card numbers with unusual separators. Boosted trees over format
and context features score each; scores are calibrated, and each kind has its own threshold.
Trees, calibration and thresholds are fitted to separate examples. Spans of the base rules always
stay; the others above their threshold are taken in one sweep from the left, unless they overlap
a base span, and of two that overlap the better one, of equally good ones the first.

On the data everything is column expressions in one projection over the scan: no shuffle, no
Python. The trees are small, are trained in numpy on the driver on examples made here, and come
to the data as a CASE expression. Offsets are prefix sums over pieces between matches, in blocks
of 64, so that they stay cheap for texts with very many matches.

Null is empty: no spans. Rows that repeat each give their own result, and other columns may be
of any name. Texts are scanned whole; the patterns are written so that none backtracks beyond
its own run of characters.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Proposals: kind, what a text must hold to be searched, pattern. The first four are the base rules' patterns,
#: written with possessive runs (no run can end early and still match) and starts at the end of the last match or of a run.
GENERATORS = (
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", r"(?i)[\[({]at[\])}]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[({]at[\])}]\x20?[a-z0-9-]++(?:\x20?[\[({]dot[\])}]\x20?[a-z0-9-]++|\.[a-z0-9-]++)++"),
    ("ip", "[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("card", "[0-9][./_][0-9]", r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}(?![0-9./_])"),
    ("phone", "[0-9]", r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}\x20)\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])"),
    ("email", r"(?i)\x20at\x20[a-z0-9-]+\x20dot\x20", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20at\x20[a-z0-9-]++(?:\x20dot\x20[a-z0-9-]++)++"),
    ("ip", "::", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z:])"),
    ("card", r"[0-9][\u00A0\u2010-\u2015\u00B7][0-9]", r"(?<![0-9\u2010-\u2015])[0-9]{4}(?:[\u00A0\u2010-\u2015\u00B7][0-9]{4}){2}[\u00A0\u2010-\u2015\u00B7][0-9]{1,7}(?![0-9\u2010-\u2015])"),
)
CONTEXT = (
    r"(?i)tel|phone|call|mobile|cell|fax|dial",
    r"(?i)mail|contact|write|reach",
    r"(?i)card|visa|master|amex|credit|payment",
    r"(?i)\bip\b|host|server|address|login|\bfrom\b",
    r"(?i)version|\bv\b|order|invoice|isbn|ticket|serial|page|section|build|\bno\b|\bid\b",
)
FEATURES = ("proposal", "length", "digits", "groups", "luhn", "octets", "letter_before", "letter_after", "same_digit", "card_start", *(f"context_{i}" for i in range(len(CONTEXT))))
TREES, RATE, BLOCK = 40, 0.3, 64


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits have a right check digit."""
    doubled = lambda d, i: F.when((i % 2) == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    total = let(F.reverse(digits), lambda r: F.aggregate(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: doubled(F.substr(r, i, F.lit(1)).cast("int"), i - 1)), F.lit(0), lambda a, x: a + x))
    return F.coalesce(F.when(F.length(digits).between(13, 19), (total % 10) == 0), F.lit(False))


def octets(match: Column) -> Column:
    return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$")


def spans(text: Column, needs: str, pattern: str) -> Column:
    """All matches as array<struct<start, end, s>>, in code points, end exclusive."""

    def placed(both: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / BLOCK).cast("int")), lambda b: F.slice(both, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda blocks: let(starts(blocks), lambda bases: F.flatten(F.transform(blocks, lambda b, i: inside(b, bases[i])))))

    def starts(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x.gap + x.n))
        return F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))

    def inside(block: Column, base: Column) -> Column:
        empty = F.array().cast("array<struct<start:bigint,end:bigint,s:string>>")
        step = lambda a, x: F.struct((a.at + x.gap + x.n).alias("at"), F.concat(a.out, F.array(F.struct((a.at + x.gap).alias("start"), (a.at + x.gap + x.n).alias("end"), x.s.alias("s")))).alias("out"))
        return F.aggregate(block, F.struct(base.alias("at"), empty.alias("out")), step, lambda a: a.out)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    found = let(hits, lambda h: F.when(F.size(h) > 0, placed(F.zip_with(F.slice(gaps, F.lit(1), F.size(h)), h, lambda g, s: F.struct(F.length(g).cast("long").alias("gap"), F.length(s).cast("long").alias("n"), s.alias("s"))))))
    may = F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs)
    return F.coalesce(F.when(may, found), F.array().cast("array<struct<start:bigint,end:bigint,s:string>>"))


def passes(kind: str, match: Column, digits: Column) -> Column:
    """The base rules' tests."""
    n = F.length(digits)
    return {"email": F.lit(True), "ip": octets(match), "card": luhn(digits), "phone": n.between(9, 15)}[kind]


def features(text: Column, proposal: int, span: Column, digits: Column) -> list[Column]:
    s = span.s
    before, after = F.substr(text, F.greatest(span.start - 23, F.lit(1)), F.least(span.start, F.lit(24))), F.substr(text, span.end + 1, F.lit(2))
    as_double = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    own = [
        F.lit(float(proposal)), as_double(F.length(s)), as_double(F.length(digits)), as_double(F.size(F.split(s, r"[^0-9A-Za-z]+"))), as_double(luhn(digits)), as_double(octets(s)),
        as_double(before.rlike(r"[\p{L}\p{N}_]$")), as_double(after.rlike(r"^[\p{L}\p{N}_]")), as_double(digits.rlike(r"^(.)\1*$")), as_double(digits.rlike("^[3-6]")),
    ]
    return own + [as_double(before.rlike(c)) for c in CONTEXT]


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, base, f>>: all proposals of a text with whether the base rules pass them, and their features."""
    out = []
    for i, (kind, needs, pattern) in enumerate(GENERATORS):
        out.append(_described(text, spans(text, needs, pattern), i, kind, base=i < len(KINDS)))
    return F.concat(*out)


def _described(text: Column, found: Column, i: int, kind: str, base: bool) -> Column:
    def one(x: Column) -> Column:
        with_digits = lambda d: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x.start.alias("start"), x.end.alias("end"), (passes(kind, x.s, d) if base else F.lit(False)).alias("base"), F.array(*features(text, i, x, d)).alias("f"))
        return let(F.regexp_replace(x.s, "[^0-9]", ""), with_digits)

    return F.transform(found, one)


class Boosted:
    """Trees of depth two for the logistic loss; Platt-calibrated; a threshold for each kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray):
        part = np.arange(len(x)) % 5
        fitted, left, judged = part < 3, part == 3, part == 4
        self.prior, self.trees, self.scale, self.shift = 0.0, [], 1.0, 0.0
        f = np.zeros(len(x))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = (y - p) * fitted, np.maximum(p * (1 - p), 1e-3) * fitted
            self.trees.append(self._tree(x, g, h))
            f += RATE * self._apply(self.trees[-1], x)
        for _ in range(200):  # calibration on rows that the trees haven't seen
            p = 1 / (1 + np.exp(-(self.scale * f + self.shift)))
            e = (p - y) * left / max(1, left.sum())
            self.scale -= 0.5 * float((e * f).sum()) / max(1.0, float(np.abs(f).max()))
            self.shift -= 0.5 * float(e.sum())
        p = self.predict(x)
        self.thresholds = []
        for k in range(len(KINDS)):  # thresholds on rows that neither has seen
            own = judged & (kind == k)
            good = [t for t in (0.5, 0.6, 0.7, 0.8, 0.9) if (own & (p >= t)).any() and y[own & (p >= t)].mean() >= 0.95]
            self.thresholds.append(good[0] if good else 0.9)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability of each row of features."""
        f = sum((RATE * self._apply(t, x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-(self.scale * f + self.shift)))

    @staticmethod
    def _split(x, g, h, rows):
        """(feature, cut, gain) of the best split of these rows."""
        best = (0, -np.inf, 0.0)
        base = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[1:]:
                left = rows[x[rows, j] < cut]
                a, b = g[left].sum(), h[left].sum()
                gain = a * a / (b + 1) + (g[rows].sum() - a) ** 2 / (h[rows].sum() - b + 1) - base
                if gain > best[2] + 1e-9:
                    best = (j, float(cut), gain)
        return best

    def _tree(self, x, g, h):
        rows = np.arange(len(x))
        j, cut, _ = self._split(x, g, h, rows)
        leaf = lambda r: float(g[r].sum() / (h[r].sum() + 1))
        sides = []
        for own in (rows[x[:, j] < cut], rows[x[:, j] >= cut]):
            if not len(own):
                sides.append((0, -np.inf, 0.0, 0.0))
                continue
            k, c, _ = self._split(x, g, h, own)
            sides.append((k, c, leaf(own[x[own, k] < c]), leaf(own[x[own, k] >= c])))
        return j, cut, *sides

    @staticmethod
    def _apply(tree, x):
        j, cut, low, high = tree
        of = lambda s: np.where(x[:, s[0]] < s[1], s[2], s[3])
        return np.where(x[:, j] < cut, of(low), of(high))

    def probability(self, f: Column) -> Column:
        """The calibrated probability as a column of the feature array ``f``."""
        real = lambda v: F.lit(float(max(v, -1e300)))
        side = lambda s: F.when(f[s[0]] < real(s[1]), F.lit(s[2])).otherwise(F.lit(s[3]))
        total = sum((F.when(f[j] < real(cut), side(low)).otherwise(side(high)) for j, cut, low, high in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-(F.lit(self.scale * RATE) * total + F.lit(self.shift))))


def examples(seed: int = 5, each: int = 40) -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, label): personal data and look-alikes in varied contexts."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))

    def card(valid: bool) -> str:
        body = rng.choice("3456") + digits(14)
        check = next(c for c in "0123456789" if sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(body + c))) % 10 == 0)
        return body + (check if valid else str((int(check) + rng.randint(1, 9)) % 10))

    groups = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))
    octet = lambda: str(rng.randint(0, 255))
    tel = ("call ", "phone: ", "Tel. ", "mobile ", "fax ")
    none = ("order ", "invoice no ", "ticket ", "serial ", "page ", "build ")
    made = {
        (0, 1): [lambda: (rng.choice(("mail ", "contact ", "write to ", "", "reach ")), f"{word()} [at] {word()} [dot] com"), lambda: (rng.choice(("", "mail ")), f"{word()}(at){word()}.org"), lambda: ("", f"{word()}@{word()}.net"), lambda: (rng.choice(("mail ", "contact ", "write to ", "reach ")), f"{word()}.{word()} at {word()} dot {word()[:3]}")],
        (0, 0): [lambda: (rng.choice(none), f"{word()}{{at}}{digits(3)}.{digits(2)}"), lambda: (rng.choice(("look ", "stop ", "")), f"{word()} at {digits(1)} dot {digits(2)}")],
        (1, 1): [lambda: (rng.choice(("host ", "from ", "server ", "ip ", "")), ".".join(octet() for _ in range(4))), lambda: (rng.choice(("host ", "server ", "ip ", "")), ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))), lambda: (rng.choice(("host ", "server ", "from ", "address ")), f"{rng.randint(4096, 65535):x}:{rng.randint(16, 65535):x}::{rng.randint(1, 65535):x}")],
        (1, 0): [lambda: (rng.choice(("version ", "section ", "", "build ")), ".".join(str(rng.randint(256, 9999)) for _ in range(4))), lambda: (rng.choice(("", "build ", "section ")), rng.choice(("ab::cd", "f::a", "::", "dead::b", "1::", "c::d")))],
        (2, 1): [lambda: (rng.choice(("card ", "visa ", "", "payment ")), groups(card(True), rng.choice(("", " ", "-")))), lambda: (rng.choice(("card ", "visa ", "payment ", "credit ")), groups(card(True), rng.choice("._/"))), lambda: (rng.choice(("card ", "visa ", "payment ", "credit ")), groups(card(True), rng.choice("\u2010\u2013\u00a0\u00b7")))],
        (2, 0): [lambda: (rng.choice((*none, "")), groups(card(False), rng.choice(("", " ", "-", ".", "_", "/", "\u2010", "\u2013", "\u00a0")))), lambda: (rng.choice((*none, "")), digits(rng.randint(2, 12)))],
        (3, 1): [lambda: (rng.choice(tel), f"({digits(3)}) {digits(3)}-{digits(4)}"), lambda: (rng.choice(tel), f"{digits(3)}-{digits(3)}-{digits(4)}"), lambda: (rng.choice((*tel, "")), f"+{digits(2)} {digits(3)} {digits(4)}")],
        (3, 0): [lambda: (rng.choice((*none, "")), f"{digits(4)}-{digits(4)}-{digits(4)}"), lambda: (rng.choice((*none, "")), f"{digits(4)} {digits(3)} {digits(3)}"), lambda: (rng.choice((*none, "")), f"+{digits(1)} {digits(2)}")],
    }
    out = []
    for (kind, label), makers in sorted(made.items()):
        for make in makers:
            for _ in range(each):
                lead, body = make()
                before = f"{word()} {word()} {lead}"
                out.append((f"{before}{body}{rng.choice((' ', '. ', ', '))}{word()}", kind, len(before), len(before) + len(body), label))
    rng.shuffle(out)
    return out


_trained: list[Boosted] = []


def trained(spark: SparkSession) -> Boosted:
    """The trees, fitted once in a process: the examples are always the same."""
    if not _trained:
        _trained.append(train(spark))
    return _trained[0]


def train(spark: SparkSession) -> Boosted:
    """Fit the trees to the proposals in the examples; the same expressions as on data give the features."""
    rows = examples()
    text = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("text")) for i, (t, *_) in enumerate(rows)])
    found = spark.range(1).select(F.inline(text)).select("i", F.explode(candidates(F.col("text"))).alias("c")).select("i", "c.kind", "c.start", "c.end", "c.f").collect()
    x, y, kind = [], [], []
    for r in sorted(found, key=lambda r: (r["i"], r["kind"], r["start"], r["end"], r["f"])):
        _, k, start, end, label = rows[r["i"]]
        x.append(r["f"])
        y.append(float(label and r["kind"] == k and r["start"] == start and r["end"] == end))
        kind.append(r["kind"])
    return Boosted(np.array(x), np.array(y), np.array(kind))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or the first of it with underscores put before, that is no column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def find(docs: DataFrame, model: Boosted, text_col: str = "text") -> DataFrame:
    """``docs`` with pii_base and pii_spans: array<struct<kind, start, end>> by kind as listed, then start (a number for the kind); columns of these names are replaced."""
    kind_type = "array<struct<kind:int,start:bigint,end:bigint>>"
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"))
    threshold = lambda k: F.array(*map(F.lit, model.thresholds))[k]

    def taken(all_: Column) -> Column:
        base = F.transform(F.filter(all_, lambda c: c.base), slim)
        scored = F.filter(F.transform(F.filter(all_, lambda c: ~c.base), lambda c: let(model.probability(c.f), lambda p: F.struct(c.start.alias("start"), c.end.alias("end"), c.kind.alias("kind"), p.alias("p")))), lambda c: c.p >= threshold(c.kind))
        fixed = F.transform(base, lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), c.kind.alias("kind"), F.lit(2.0).alias("p")))
        empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,p:double>>")
        last = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1)).end, F.lit(0))
        short = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))

        def step(acc: Column, c: Column) -> Column:
            over = last(acc.kept) > c.start
            better = F.coalesce(c.p > F.try_element_at(acc.kept, F.lit(-1)).p, F.lit(True))
            after_base = F.struct(F.greatest(acc.upto, c.end).alias("upto"), F.when(over, short(acc.kept)).otherwise(acc.kept).alias("kept"))
            chosen = F.when((c.start < acc.upto) | (over & ~better), acc.kept).when(over, F.concat(short(acc.kept), F.array(c))).otherwise(F.concat(acc.kept, F.array(c)))
            return F.when(c.p > 1, after_base).otherwise(F.struct(acc.upto.alias("upto"), chosen.alias("kept")))

        swept = F.aggregate(F.array_sort(F.concat(fixed, scored)), F.struct(F.lit(0).cast("long").alias("upto"), empty.alias("kept")), step, lambda a: a.kept)
        added = F.when(F.size(scored) > 0, F.transform(swept, slim)).otherwise(F.array().cast(kind_type))
        return F.struct(F.array_sort(base).alias("base"), F.array_sort(F.concat(base.cast(kind_type), added)).alias("spans"))

    found = let(candidates(text), taken)
    docs = docs.drop("pii_base", "pii_spans")
    name = unused(docs, "pii")
    return docs.withColumn(name, found).withColumn("pii_base", F.col(f"{name}.base")).withColumn("pii_spans", F.col(f"{name}.spans")).drop(name)


def redact(docs: DataFrame, model: Boosted, text_col: str = "text") -> DataFrame:
    """``docs`` with every span found in its text replaced by the kind's name in brackets; overlapping base spans are replaced from the first start to the last end."""
    marked = find(docs, model, text_col)
    by_start = F.array_sort(F.transform("pii_spans", lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), c.kind.alias("kind"))))
    text = F.col(text_col)
    name = lambda k: F.concat(F.lit("["), F.array(*map(F.lit, KINDS))[k], F.lit("]"))
    step = lambda a, c: F.when(c.start < a.at, F.struct(F.greatest(a.at, c.end).alias("at"), a.out.alias("out"))).otherwise(F.struct(c.end.alias("at"), F.concat(a.out, F.substr(text, a.at + 1, c.start - a.at), name(c.kind)).alias("out")))
    done = F.aggregate(by_start, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a.out, F.substr(text, a.at + 1, F.length(text).cast("long"))))
    return marked.withColumn(text_col, F.when(F.size("pii_spans") > 0, done).otherwise(text)).drop("pii_base", "pii_spans")


def find_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find(docs.select("doc_id", "text"), trained(docs.sparkSession)).select("doc_id", "pii_base", "pii_spans")
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", names[x.kind], x.start, x.end)), ",")
    counts = [F.expr(f"cast(size(filter(pii_base, x -> x.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))

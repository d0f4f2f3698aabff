"""Personal data spans by weak supervision, in column expressions only.

The stated patterns give the base spans. Looser patterns propose more candidates (spelled-out e-mail addresses, IPv6, card
numbers with other separators, phone numbers without a plus). Four labelers vote on every candidate of either sort: the
strict pattern, the shape (checksum, plausible parts), a gazetteer (name endings, issuer prefixes, country codes) and
the words before it. Expectation-maximisation over the counts of vote patterns estimates how far each labeler can be
trusted, and the resulting soft labels train the final span classifier, a logistic regression per kind on votes and
span features. Base spans always stay; a looser candidate is added when the classifier says at least one half and it
overlaps no base span.

Spark counts vote patterns over all candidates; the driver sees one row per distinct pattern (at most a few hundred
per kind, whatever the input) and gives back a few numbers per kind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemolake.llm.shared import Registry, let, stored, table

registry = Registry()

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "shape", "gazetteer", "context")
SPAN = "struct<start:int,end:int,value:string,before:string>"
CONTEXT = 40

# The stated patterns. Possessive repeats and look-behinds only cut useless retries: a run of characters that fails from its
# start fails from every later place in it, and a match may begin right where the last one ended (\G).
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[a-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: what a text must contain before a pattern is worth running
NEEDS = {"email": "@", "phone": "+"}
LOOSE_NEEDS = {
    "email": r"(?i)[\[(] ?at ?[\])]", "ip": "(?:[0-9A-Fa-f]{1,4}:){7}", "card": "[0-9][./_][0-9]{4}[./_]", "phone": "[0-9]{3}[) .-][ ]?[0-9]{3}[ .-][0-9]{4}",
}
TOP_LEVEL = r"(?i)(?:\.|dot ?[\])] ?)(?:com|org|net|edu|gov|io|info|biz|eu|de|fr|es|it|nl|uk|ch|at|be|us|ca|pt|pl|se)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|30[0-5]|6011|65|62|35)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT_WORDS = {
    "email": r"(?i)(?:e-?mail|mail|contact|correo|courriel|kontakt|write to|reach)[^0-9@]*$",
    "ip": r"(?i)(?:\bip\b|address|host|server|from|login|adresse|direcci.n)[^0-9]*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta|payment)[^0-9]*$",
    "phone": r"(?i)(?:phone|tel\b|tel\.|telefon|t.l.fono|t.l.phone|call|fax|mobile|handy|whatsapp)[^0-9+]*$",
}
AGAINST = r"(?i)(?:version|invoice|order|isbn|issn|serial|ticket|item|sku|part no|build|release|section|ratio)[^0-9]*$"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with code point positions and the text before them."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")

    def walk(state, pair):
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        low = F.greatest(F.lit(0), start - CONTEXT)
        span = F.struct(
            start.alias("start"), end.alias("end"), pair["value"].alias("value"), F.substring(text, low + 1, start - low).alias("before")
        )
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    # the piece after the last match has no value
    pairs = F.filter(F.zip_with(pieces, found, lambda p, v: F.struct(p.alias("piece"), v.alias("value"))), lambda x: x["value"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, walk, lambda s: s["out"])).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    """Four numbers of at most 255, whatever zeros lead them."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "").rlike(rf"^{octet}(?:\.{octet}){{3}}$")


def valid(kind: str, value: Column) -> Column:
    """The stated condition of a base match."""
    digits = _digits(value)
    if kind == "ip":
        return _octets(value)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def votes(kind: str, strict: bool, s: Column) -> list[Column]:
    """One vote per labeler: 1 for, -1 against, 0 no opinion."""
    value, digits = s["value"], _digits(s["value"])
    for_, against = F.lit(1), F.lit(-1)
    shape = {
        "email": F.length(value).between(6, 254) & ~value.contains(".."),
        "ip": ~value.rlike(r"^(?:0|255)\.|^0*:"),
        "card": F.length(digits).between(13, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(9, 15) & ~digits.rlike(r"^(?:[01]..|...[01])") if not strict else F.length(digits).between(10, 13),
    }[kind]
    known = {
        "email": value.rlike(TOP_LEVEL), "ip": value.rlike(r"^(?:10|127|169\.254|192\.168|2001|fe80)"), "card": digits.rlike(ISSUERS),
        "phone": value.rlike(COUNTRIES),
    }[kind]
    pattern = F.when(valid(kind, value), for_).otherwise(against) if strict else F.lit(0)
    context = F.when(s["before"].rlike(CONTEXT_WORDS[kind]), for_).when(s["before"].rlike(AGAINST), against).otherwise(F.lit(0))
    return [pattern, F.when(shape, for_).otherwise(against), F.when(known, for_).otherwise(F.lit(0)), context]


def span_features(s: Column) -> list[Column]:
    """Bounded features of the classifier beside the votes: length class and share of separators."""
    length = s["end"] - s["start"]
    marks = F.length(F.regexp_replace(s["value"], "[A-Za-z0-9]", ""))
    return [F.when(length < 12, 0).when(length < 20, 1).otherwise(2), F.when(marks == 0, 0).when(marks <= 3, 1).otherwise(2)]


def candidates(text: Column) -> Column:
    """All candidates of a text: kind, sort (base or not), span, votes and features."""

    def judged(kind, strict):
        return lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            (F.lit(strict) & valid(kind, s["value"])).alias("base"),
            F.array(*votes(kind, strict, s)).alias("votes"), F.array(*span_features(s)).alias("features"),
        )

    lists = []
    for kind in KINDS:
        test = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
        lists.append(F.when(test, F.transform(matches(text, BASE[kind]), judged(kind, True))))
        lists.append(F.when(text.rlike(LOOSE_NEEDS[kind]), F.transform(matches(text, LOOSE[kind]), judged(kind, False))))
    return F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))


# --- label model and classifier, on counts of patterns ---------------------------------------------------------------


def reliabilities(rows: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict]]:
    """Expectation-maximisation for labelers that are independent given the truth.

    ``rows`` are (votes, count). Returns the share of true candidates and per labeler the probability of each vote
    for true and false candidates. It starts from labelers that are right four times in five.
    """
    n = len(rows[0][0]) if rows else 0
    share = 0.5
    table = [{v: ((0.8, 0.2) if v > 0 else (0.2, 0.8) if v < 0 else (0.5, 0.5)) for v in (-1, 0, 1)} for _ in range(n)]
    for _ in range(rounds):
        true = [{v: 1.0 + (v > 0) for v in (-1, 0, 1)} for _ in range(n)]  # a weak prior keeps labelers the right way round
        false = [{v: 1.0 + (v < 0) for v in (-1, 0, 1)} for _ in range(n)]
        mass = total = 0.0
        for vote, count in rows:
            p = posterior(vote, share, table)
            mass, total = mass + p * count, total + count
            for i, v in enumerate(vote):
                true[i][v] += p * count
                false[i][v] += (1 - p) * count
        share = (mass + 1) / (total + 2)
        table = [
            {v: (t[v] / sum(t.values()), f[v] / sum(f.values())) for v in (-1, 0, 1)} for t, f in zip(true, false)
        ]
    return share, table


def posterior(vote: tuple[int, ...], share: float, table: list[dict]) -> float:
    log_odds = math.log(share / (1 - share)) + sum(math.log(table[i][v][0] / table[i][v][1]) for i, v in enumerate(vote))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds))))


def classifier(rows: list[tuple[tuple[float, ...], float, int]], rounds: int = 300) -> list[float]:
    """Logistic regression by gradient steps on (features, soft label, count); intercept first."""
    if not rows:
        return []
    weights = [0.0] * (len(rows[0][0]) + 1)
    total = sum(c for _, _, c in rows)
    for _ in range(rounds):
        gradient = [-0.001 * w for w in weights]
        for x, p, c in rows:
            z = weights[0] + sum(w * v for w, v in zip(weights[1:], x))
            off = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * c / total
            gradient[0] += off
            for i, v in enumerate(x, 1):
                gradient[i] += off * v
        weights = [w + 1.0 * g for w, g in zip(weights, gradient)]
    return weights


def train(patterns: list[tuple[int, tuple[int, ...], tuple[int, ...], int]]) -> dict[int, list[float]]:
    """Classifier weights per kind from (kind, votes, features, count)."""
    models = {}
    for kind in range(len(KINDS)):
        mine = [(v, f, c) for k, v, f, c in patterns if k == kind]
        if mine:
            share, table_ = reliabilities([(v, c) for v, _, c in mine])
            # the strict pattern's own vote is left out: loose candidates are to be judged by what they share with strict ones
            models[kind] = classifier([((*v[1:], *f), posterior(v, share, table_), c) for v, f, c in mine])
    return models


# --- the operator --------------------------------------------------------------------------------------------------


def learn(found: DataFrame) -> dict[int, list[float]]:
    """Fit the label model and the classifiers to a table with candidates in ``c``."""
    counted = found.select(F.explode("c").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))
    rows = counted.orderBy("kind", "votes", "features").collect()
    return train([(r.kind, tuple(r.votes), tuple(r.features), r.n) for r in rows])


def base_spans(c: Column) -> Column:
    return F.array_sort(F.transform(F.filter(c, lambda x: x["base"]), _plain))


def added_spans(c: Column, models: dict[int, list[float]]) -> Column:
    """Loose candidates that the classifier accepts and that overlap no base span."""

    def likely(x):
        out = F.lit(False)
        for kind, weights in models.items():
            inputs = [x["votes"][i] for i in range(1, len(LABELERS))] + [x["features"][i] for i in range(2)]
            z = sum((F.lit(w) * v for w, v in zip(weights[1:], inputs)), F.lit(weights[0]))
            out = F.when(x["kind"] == kind, z >= 0).otherwise(out)
        return out

    def clear(base):
        loose = F.filter(c, lambda x: (x["votes"][0] == 0) & likely(x))  # only loose candidates have no strict vote
        free = F.filter(loose, lambda x: ~F.exists(base, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"])))
        return F.array_sort(F.transform(free, _plain))

    return let(base_spans(c), clear)


def _plain(x: Column) -> Column:
    return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``base`` and ``added`` spans (kind number, start, end; sorted).

    Positions count code points, the end is exclusive. Null texts count as empty. Matches of one kind never overlap;
    those that fail their condition are dropped. Repeated rows give repeated rows; an empty table gives none.
    Spans of different kinds may overlap; added ones overlap no base span of any kind.
    """
    found = stored(docs.select(F.col(id_col), candidates(F.coalesce(text_col, F.lit(""))).alias("c")), "pii-candidates")
    models = learn(found)
    return found.select(id_col, base_spans(F.col("c")).alias("base"), added_spans(F.col("c"), models).alias("added"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] < state["at"], state["out"]).otherwise(F.array_append(F.array_append(state["out"], gap), F.get(names, s["kind"]))).alias("out"),
        )

    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    built = F.aggregate(
        by_place, begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, built).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with personal data in the text redacted. Null texts stay null; no row is moved or lost.

    Two passes: one counts vote patterns and fits the models, the other rewrites each text within its row.
    """
    found = docs.select(candidates(F.coalesce(text_col, F.lit(""))).alias("c"))
    models = learn(found)
    marked = docs.withColumn("_c", candidates(F.coalesce(text_col, F.lit(""))))
    spans = F.concat(base_spans(F.col("_c")), added_spans(F.col("_c"), models))
    return marked.withColumn("_spans", spans).withColumn(text_col, redacted(F.col(text_col), F.col("_spans"))).drop("_c", "_spans")


@registry.add("op5_weak_supervision_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id", *[number(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )

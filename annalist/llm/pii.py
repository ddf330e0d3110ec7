"""Personal data and secrets: base patterns, and further spans by weak supervision.

Base kinds are found by pattern and checked (address parts, Luhn digit, number
of digits). On top, candidates for secrets and for names of persons are voted
on by a pattern, a gazetteer and a context labeler. Expectation-maximisation
over the vote patterns estimates how reliable each labeler is, and the
posteriors train the final span classifier, a naive Bayes over what the
labelers do not look at: character classes, their changes, length, distinct
characters, and neighbours. A span's score is the classifier's odds together
with those of the votes at their estimated reliabilities; spans that score
above zero are added, and no rule stands beside the score. A labeler that says
nothing counts for nothing: where a corpus names all its secrets, a bare one
is no less a secret. Base spans stay, and added ones overlap neither them nor
each other.

Spans come from splitting a text at a pattern: lengths of the pieces between
and of the finds, summed up, are the positions. Every step is a built-in
function. What is collected for fitting is one row per pattern of votes and
features, at most ``MOST_PATTERNS`` a kind by construction, whatever the input.

Defined results: null text counts as empty and has no spans; an empty table
gives an empty table, and the classifier then is what the labelers' initial
weights make it; repeated rows are judged each on its own; ties and overlaps go
to the span that begins first, then to the kind listed first; extra columns
are kept by ``detect``, whose result columns get a number where the input has
their names (``names.free_name``).

Positions are in code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.names import free_name

# Possessive forms and look-behinds keep matching linear in the text. They find
# the same as the plain patterns: what follows a run is never part of it, and a
# match that starts inside a run would also start where the run, or what the
# last match has left of it, begins.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
# Runs of the base64, base64url and JWT alphabets; two dots part them, and "=" is
# only padding, so that a name and its value are two runs.
CANDIDATE = (
    r"(?<![A-Za-z0-9_/+-])(?<![A-Za-z0-9_/+-]\.)(?=[A-Za-z0-9_/+.-]{16})(?=(?:[A-Za-z_/+-]++|\.(?!\.))*+[0-9]|AKIA)"
    r"[/+]*+[A-Za-z0-9_-]++(?:(?:[/+]++|\.(?!\.))[A-Za-z0-9_-]++)*+[/+]*+(?:={1,2}+(?![\"']?[A-Za-z0-9_/+=-]))?+"
)
# Formats that secrets have and little else.
KNOWN = (
    r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*)$"
    r"|(?:^|[/.+])(?:ghp_[A-Za-z0-9]{16,}|sk-(?:[A-Za-z0-9]+[_-])*[A-Za-z0-9]{16,}|AKIA[A-Z0-9]{12,}|xox[bp]-[A-Za-z0-9-]{10,})"
)
# Digits only, or words and numbers with marks between: dates, paths, names of files and hosts.
ORDINARY = r"^(?:[0-9_/+.=-]+|(?:[A-Za-z]{2,}[0-9]?|[0-9]{1,8})(?:[-_/.]+(?:[A-Za-z]{2,}[0-9]?|[0-9]{1,8}))+)$"
PERSON = r"(?<![A-Za-z])[A-Z][a-z]++(?: [A-Z]\.)? [A-Z][a-z]++(?![A-Za-z])"

# Words that name secrets.
GAZETTEER = ("api", "auth", "bearer", "credential", "key", "passphrase", "passwd", "password", "pwd", "secret", "token")
# Given names, what stands before a name, and words that begin sentences.
GIVEN = (
    "Alice", "Anna", "Barbara", "Carlos", "Charles", "David", "Elena", "Elizabeth", "Emma", "Fatima", "George", "Hans", "Ivan", "James", "Jane", "Jennifer", "Johann",
    "John", "Jose", "Joseph", "Juan", "Karen", "Laura", "Linda", "Luis", "Maria", "Marie", "Mark", "Mary", "Michael", "Mohammed", "Nancy", "Olga", "Patricia", "Paul",
    "Peter", "Pierre", "Richard", "Robert", "Sarah", "Susan", "Thomas", "William",
)
TITLED = r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof)\.? )$"
NAMED = r"(?i)(?:\b(?:my name is|i am|signed|sincerely|regards|dear|contact|patient|customer|name ?:|attn ?:),?\s+)$"
OPENING = r"^(?:A|All|An|And|At|But|For|From|He|Her|His|How|If|In|It|My|No|Not|Of|On|Or|Our|She|So|That|The|Their|Then|There|These|They|This|To|We|What|When|With|You|Your) "
CONTEXT = 24
BLOCK = 256
ROUNDS = 30
PIECES = "array<struct<start:int,end:int,found:string,before:string,after:string>>"
SPANS = "array<struct<kind:string,start:int,end:int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value, so that it is made once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str) -> Column:
    """All finds of a pattern with their place, the characters before them and the one after.

    Lengths are summed up in blocks, so a text with n finds costs n * (BLOCK + n / BLOCK).
    """

    def before(pair: Column, i: Column) -> Column:
        """The CONTEXT characters before a find, where two finds and the gap between are as long as that."""
        last = [(pair["found"], i - 2), (pair["gaps"], i - 1), (pair["found"], i - 1), (pair["gaps"], i)]
        return F.right(F.concat(*[F.coalesce(F.right(F.get(column, at), F.lit(CONTEXT)), F.lit("")) for column, at in last]), F.lit(CONTEXT))

    def placed(pair: Column) -> Column:
        def sums(steps: Column) -> Column:
            n = F.size(steps)
            blocks = F.transform(F.sequence(F.lit(0), F.shiftright(n, 8)), lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))
            return let(
                blocks,
                lambda made: F.transform(
                    pair["found"],
                    lambda m, i: let(
                        F.aggregate(F.slice(made, F.lit(1), F.shiftright(i, 8)), F.lit(0), lambda a, x: a + x)
                        + F.aggregate(F.slice(steps, F.shiftright(i, 8) * BLOCK + 1, i % BLOCK), F.lit(0), lambda a, x: a + x)
                        + F.length(F.element_at(pair["gaps"], i + 1)),
                        lambda at: F.struct(
                            at.alias("start"), (at + F.length(m)).alias("end"), m.alias("found"), before(pair, i).alias("before"), F.left(F.element_at(pair["gaps"], i + 2), F.lit(1)).alias("after")
                        ),
                    ),
                ),
            )

        return let(F.transform(pair["found"], lambda m, i: F.length(m) + F.length(F.element_at(pair["gaps"], i + 1))), sums)

    pair = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), let(pair, placed)).otherwise(F.array().cast(PIECES))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _base(text: Column) -> dict[str, Column]:
    return {
        "email": F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(F.array().cast(PIECES)),
        "ip": F.filter(located(text, IP), lambda p: p["found"].rlike(OCTETS)),
        "card": F.filter(
            located(text, CARD),
            lambda p: F.when(F.length(_digits(p["found"])).between(13, 19), F.call_function("luhn_check", _digits(p["found"]))).otherwise(F.lit(False)),
        ),
        "phone": F.filter(
            F.when(F.contains(text, F.lit("+")), located(text, PHONE)).otherwise(F.array().cast(PIECES)),
            lambda p: F.length(_digits(p["found"])).between(9, 15),
        ),
    }


def _spans(kind: str, pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.struct(F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end")))


# --- weak supervision -------------------------------------------------------


class Kind(NamedTuple):
    """Spans that labelers and the classifier decide on. Candidates have at least ``least`` characters."""

    pattern: str
    least: int
    #: found, before, after to votes, 1 for, -1 against and 0 for none
    votes: Callable[[Column, Column, Column], tuple[Column, ...]]
    #: found, before, after to features with the number of their values, from 0
    features: Callable[[Column, Column, Column], tuple[tuple[Column, int], ...]]


def _steps(value: Column, *limits: float) -> tuple[Column, int]:
    """How many limits a value reaches, and that there are so many values."""
    return sum((F.when(value >= x, 1).otherwise(0) for x in limits), F.lit(0)), len(limits) + 1


def _first_of(*tests: Column) -> tuple[Column, int]:
    """The number of the first test that holds, from 1, or 0."""
    out = F.lit(0)
    for i in range(len(tests), 0, -1):
        out = F.when(tests[i - 1], i).otherwise(out)
    return out, len(tests) + 1


def _distinct(found: Column) -> Column:
    return F.size(F.array_distinct(F.split(found, "")))


def _secret_votes(found: Column, before: Column, after: Column) -> tuple[Column, ...]:
    return (
        F.when(found.rlike(ORDINARY), -1).when(found.rlike(KNOWN), 1).otherwise(0),
        F.when(F.lower(before).rlike("(?:" + "|".join(GAZETTEER) + ")"), 1).otherwise(0),
        F.when(before.rlike(r"""[=:]\s*["']?$"""), 1).otherwise(0),
    )


def _secret_features(found: Column, before: Column, after: Column) -> tuple[tuple[Column, int], ...]:
    n = F.length(found)
    return (
        _steps(n, 20, 28, 36, 48),
        _first_of(found.rlike("^[0-9a-f]+$"), found.rlike("^[A-Za-z0-9]+$"), found.rlike("^[A-Za-z0-9_-]+$"), found.rlike("^[A-Za-z0-9/+=]+$")),
        _steps(F.regexp_count(found, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) / n, 0.08, 0.2, 0.35),
        _steps(_distinct(found) / n, 0.2, 0.34, 0.5, 0.7),
        _steps(F.regexp_count(found, F.lit("[0-9]")) / n, 0.1, 0.3, 0.7),
        _first_of(found.rlike("[A-Z]") & found.rlike("[a-z]"), found.rlike("[A-Z]")),
        _first_of(found.rlike("[a-z]{6}|[A-Z]{8}"), found.rlike("[A-Za-z]{4}")),
        _first_of(after.rlike("[\"'`]"), after.rlike(r"[\s,;)]")),
    )


def _name_votes(found: Column, before: Column, after: Column) -> tuple[Column, ...]:
    return (
        F.when(found.rlike(OPENING), -1).when(before.rlike(TITLED), 1).otherwise(0),
        F.when(found.rlike("^(?:" + "|".join(GIVEN) + ") "), 1).otherwise(0),
        F.when(before.rlike(NAMED), 1).otherwise(0),
    )


def _name_features(found: Column, before: Column, after: Column) -> tuple[tuple[Column, int], ...]:
    return (
        _steps(F.length(F.substring_index(found, " ", 1)), 4, 7, 10),
        _steps(F.length(F.substring_index(found, " ", -1)), 4, 7, 10),
        _first_of(before == "", before.rlike(r"[.!?\n]\s*$"), before.rlike(r"[A-Z]\w* $"), before.rlike(r"[a-z] $")),
        _first_of(after.rlike(r"[,.;:]"), after.rlike(r"\s"), after == ""),
        _first_of(found.rlike(r" [A-Z]\. ")),
    )


#: In this order added spans are listed, after the base kinds.
KINDS = {"secret": Kind(CANDIDATE, 16, _secret_votes, _secret_features), "name": Kind(PERSON, 5, _name_votes, _name_features)}
LABELERS = 3
MOST_PATTERNS = 3 * 2 * 2 * 5 * 5 * 4 * 5 * 4 * 3 * 3 * 3
#: Share of the features' odds that counts, as they tell much of the same.
TEMPER = 0.5
#: How often each labeler is taken to be right before anything is seen, which weighs as much as all its votes, and the most it is trusted.
RIGHT, MOST_RIGHT = (0.98, 0.85, 0.85), 0.995
#: Probability of a candidate on which no labeler votes.
SILENT = 0.02
#: Weight of what all candidates have in a feature, in counts, against what a class has.
POOLED = 2.0


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def vote_reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[list[float], dict[tuple[int, ...], float]]:
    """EM over vote patterns: how often each labeler is right where it votes, and each pattern's posterior.

    Odds are even before the votes, a labeler that says nothing adds nothing to
    them, and where none says anything the posterior is ``SILENT``; how common
    spans are is the classifier's to learn. Starts from the votes' sum; the
    rounds are fixed, so reruns agree.
    """
    labelers = len(next(iter(patterns), (0,) * LABELERS))
    posterior = {v: 1 / (1 + math.exp(-2.0 * sum(v))) if any(v) else SILENT for v in patterns}
    right = list(RIGHT[:labelers])
    for _ in range(rounds):
        for k in range(labelers):
            own = [(n, posterior[v] if v[k] > 0 else 1 - posterior[v]) for v, n in patterns.items() if v[k]]
            if own:
                right[k] = min(MOST_RIGHT, (sum(n * p for n, p in own) / sum(n for n, _ in own) + RIGHT[k]) / 2)
        for v in patterns:
            if any(v):
                posterior[v] = 1 / (1 + math.exp(-sum(x * _logit(r) for x, r in zip(v, right, strict=True))))
    return right, posterior


def _candidates(text: Column, kind: str = "secret") -> Column:
    return F.filter(located(text, KINDS[kind].pattern), lambda p: F.length(p["found"]) >= KINDS[kind].least)


def _trained(rows: list[tuple], kind: str) -> dict:
    """From rows of votes, features and their count: the weights of votes and feature values, and the intercept."""
    values = [n for _, n in KINDS[kind].features(*[F.lit("")] * 3)]
    patterns: dict[tuple[int, ...], int] = {}
    for r in rows:
        patterns[r[:LABELERS]] = patterns.get(r[:LABELERS], 0) + r[-1]
    right, posterior = vote_reliabilities(patterns)
    total = sum(r[-1] for r in rows)
    yes = sum(r[-1] * posterior[r[:LABELERS]] for r in rows)
    no = total - yes
    features = []
    for i, n in enumerate(values, LABELERS):
        weights = []
        for x in range(n):
            a = sum(r[-1] * posterior[r[:LABELERS]] for r in rows if r[i] == x)
            b = sum(r[-1] * (1 - posterior[r[:LABELERS]]) for r in rows if r[i] == x)
            # drawn to what all candidates have, so that a value never seen says nothing
            pooled = POOLED * (a + b) / max(total, 1)
            weights.append(TEMPER * (math.log((a + pooled) / (yes + POOLED)) - math.log((b + pooled) / (no + POOLED))) if a + b else 0.0)
        features.append(weights)
    votes = [{x: x * _logit(r) for x in (-1, 0, 1)} for r in right]
    return {"intercept": math.log((yes + SILENT) / (no + 1 - SILENT)), "votes": votes, "features": features}


def fit(documents: DataFrame, text_column: str = "text") -> dict:
    """For each kind the span classifier: an intercept, and a weight for each vote and each value of each feature.

    Reads every candidate of every text; they are counted by votes and features on the executors.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))

    def told(kind: str) -> Column:
        return F.transform(_candidates(text, kind), lambda p: F.struct(F.lit(kind).alias("kind"), *[p[x].alias(x) for x in ("found", "before", "after")]))

    c = documents.select(F.explode(F.concat(*[told(k) for k in KINDS])).alias("c")).select("c.*")
    around = [F.col(x) for x in ("found", "before", "after")]
    held: list[Column] = []
    for name, kind in KINDS.items():
        own = [v.cast("int") for v in kind.votes(*around)] + [f.cast("int") for f, _ in kind.features(*around)]
        for i, column in enumerate(own):
            if i == len(held):
                held.append(F.lit(0))
            held[i] = F.when(F.col("kind") == name, column).otherwise(held[i])
    names = [f"c{i}" for i in range(len(held))]
    counted = c.select("kind", *[h.alias(n) for h, n in zip(held, names, strict=True)]).groupBy("kind", *names).count().collect()
    rows: dict[str, list[tuple]] = {k: [] for k in KINDS}
    for r in sorted(map(tuple, counted)):
        rows[r[0]].append(r[1:])
    return {k: _trained(rows[k], k) for k in KINDS}


def score(found: Column, before: Column, after: Column, model: dict, kind: str = "secret") -> Column:
    """Log odds that a candidate is of a kind."""
    out = F.lit(float(model[kind]["intercept"]))
    for vote, weights in zip(KINDS[kind].votes(found, before, after), model[kind]["votes"], strict=True):
        out = out + F.element_at(F.array(*[F.lit(float(weights[x])) for x in (-1, 0, 1)]), vote + 2)
    for (feature, _), weights in zip(KINDS[kind].features(found, before, after), model[kind]["features"], strict=True):
        out = out + F.element_at(F.array(*[F.lit(float(w)) for w in weights]), feature + 1)
    return out


def _overlaps(s: Column, others: Column) -> Column:
    return F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def detect(documents: DataFrame, text_column: str = "text", model: dict | None = None, base_column: str = "pii_base", spans_column: str = "pii_spans") -> DataFrame:
    """The documents with their base spans and all spans, as arrays of (kind, start, end)."""
    return _detected(documents, text_column, model).select(
        *[F.col(f"row.`{c}`").alias(c) for c in documents.columns],
        F.col("base").alias(free_name(base_column, documents.columns)),
        F.col("spans").alias(free_name(spans_column, [*documents.columns, base_column])),
    )


def _detected(documents: DataFrame, text_column: str, model: dict | None) -> DataFrame:
    """``row`` (the input's columns), ``base, spans``."""
    model = model or fit(documents, text_column)
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    base = F.concat(*[_spans(k, p) for k, p in _base(text).items()]).cast(SPANS)
    found = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), text.alias("text"), base.alias("base"))

    def adding(kind: str) -> Callable[[Column], Column]:
        own = F.filter(_candidates(F.col("text"), kind), lambda p: score(p["found"], p["before"], p["after"], model, kind) > 0)
        return lambda held: F.concat(held, F.filter(_spans(kind, own).cast(SPANS), lambda s: ~_overlaps(s, held)))

    spans = F.col("base")
    for kind in KINDS:
        # bound once, as the test looks at all spans so far for each
        spans = let(spans, adding(kind))
    return found.select("row", "base", spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """A text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        more = F.array(F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        fresh = s["start"] >= done["at"]
        return F.struct(
            F.when(fresh, F.concat(done["parts"], more)).otherwise(done["parts"]).alias("parts"), F.greatest(done["at"], s["end"]).alias("at")
        )

    def join(done: Column) -> Column:
        return F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, join)).otherwise(text)


def redact(documents: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The documents with their spans redacted; the columns of the input, the length anew. Null texts stay null."""
    text, spans = F.col(f"row.`{text_column}`"), F.col("spans")
    clean = F.when(text.isNull(), F.lit(None)).otherwise(redacted(text, spans))
    found = _detected(documents, text_column, None).select("row", "spans", clean.alias("clean"))

    def column(name: str) -> Column:
        if name == text_column:
            return F.col("clean")
        if name == length_column:
            return F.when(F.size("spans") > 0, F.length("clean").cast(documents.schema[name].dataType)).otherwise(F.col(f"row.`{name}`"))
        return F.col(f"row.`{name}`")

    return found.select(*[column(c).alias(c) for c in documents.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    from annalist.sources.tables import table

    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(shown(F.col("pii_base")), 256).alias("base_sha256"),
        shown(F.col("pii_spans")).alias("spans"),
        count("secret").alias("n_secret"),
        count("name").alias("n_name"),
    )

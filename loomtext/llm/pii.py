"""Personal data by weak supervision, in built-in Spark expressions (operator 3).

Patterns propose spans.  Regex, gazetteer and context labelers vote on each;
expectation-maximisation over the counts of equal votes estimates how far each
labeler can be trusted; its beliefs are the soft labels of a final classifier on
votes and shapes, which decides about every span that the strict rules leave open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.words import free_names

KINDS = ("email", "ip", "card", "phone")

# A search that starts inside a run which has already failed from its beginning
# fails again, so patterns start at the border of a run or where the last match
# ended (\G).  With possessive repeats no text needs more than linear time.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms that only the votes can admit.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
}
# A text without this character has no match; null: always searched.
NEEDS = {("email", True): "@", ("phone", True): "+", ("email", False): "at", ("ip", False): ":"}

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Gazetteers: endings of mail hosts, calling codes, card issuers, special networks.
HOST_ENDINGS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|ch|at|pl|eu|us|ca|br|in|jp|cn|ru"
CALLING_CODES = "1|7|20|27|3[0-4]|36|39|4[0-1]|4[3-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CARD_ISSUERS = "4|5[1-5]|2[2-7]|3[4-7]|6(?:011|4|5)"
SPECIAL_NETWORKS = r"0+\.|127\.|255\.|22[4-9]\.|23[0-9]\.|192\.0\.2\."
CONTACT_WORDS = "mail|e-mail|contact|write|call|phone|tel|fax|mobile|card|visa|mastercard|pay|address|host|server|from|user|customer"
OTHER_WORDS = "version|release|isbn|issn|section|chapter|figure|fig|page|article|table|order|build|invoice|id"
CONTEXT = 24  # characters looked at before a span
LABELERS = 6
ITERATIONS = 25

MATCH_TYPE = "array<struct<kind:int,start:int,end:int,base:boolean,value:string,before:string,after:string>>"
SPAN_TYPE = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,shape:array<string>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, zero: Column, combine: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """What ``combine`` makes of the first 1, 2, ... values.

    Each value is combined with its own block of 64 and with what the same does
    for all blocks before, so the work a value is bounded up to millions of them.
    Arrays used in lambdas are bound first: else they are made anew each time.
    """
    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: combine(a, x))

    def short(own: Column) -> Column:
        return F.transform(own, lambda _, i: fold(F.slice(own, 1, i + 1)))

    def long(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(own) - 1, 6)), lambda b: fold(F.slice(own, b * 64 + 1, 64)))
        return let(scan(blocks, zero, combine, levels - 1), lambda upto: F.transform(own, lambda _, i: combine(
            F.coalesce(F.get(upto, F.shiftright(i, 6) - 1), zero), fold(F.slice(own, i - i % 64 + 1, i % 64 + 1))
        )))

    return let(values, short if levels == 0 else lambda own: F.when(F.size(own) <= 64, short(own)).otherwise(long(own)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    doubled = F.transform(
        F.sequence(F.lit(0), F.length(digits) - 1),
        lambda i: let(F.substring(digits, -1 - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False)
    return n.between(9, 15)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for personal data, 0 against, -1 for no vote."""
    vote = F.when(yes, 1)
    return (vote.otherwise(0) if no is None else vote.when(no, 0).otherwise(-1)).cast("int")


def _votes(kind: str, strict: bool, value: Column, before: Column, after: Column, several: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    form = _vote(_valid(kind, value)) if strict else F.lit(-1)
    if kind == "email":
        shape, listed = _vote(value.rlike(r"[A-Za-z]{2,24}[\])]?$")), _vote(value.rlike(rf"(?i)[. ](?:{HOST_ENDINGS})$"))
    elif kind == "ip":
        shape = _vote(value.rlike(r"[0-9]{2}|:"), ~value.rlike(r"[0-9]{2}|:"))
        listed = _vote(~value.rlike(rf"^(?:{SPECIAL_NETWORKS})"))
    elif kind == "card":
        shape, listed = _vote(n.between(13, 19)), _vote(digits.rlike(rf"^(?:{CARD_ISSUERS})"))
    else:
        shape = _vote(n.between(9, 13), (n < 7) | (n > 15))
        listed = _vote(value.rlike(rf"^\+(?:{CALLING_CODES})"), value.startswith("+"))
    words = F.lower(before)
    context = _vote(words.rlike(rf"\b(?:{CONTACT_WORDS})\b"), words.rlike(rf"\b(?:{OTHER_WORDS})\b\W*$"))
    glued = before.rlike(r"[\p{L}\p{N}_/=-]$") | after.rlike(r"^[\p{L}\p{N}_/=-]")
    border = _vote(~glued)
    company = F.when(several, 1).otherwise(-1).cast("int")
    return F.array(form.cast("int"), shape, listed, context, border, company)


def _shape(kind: str, strict: bool, value: Column, before: Column, after: Column) -> Column:
    """Bucketed features of a span: a few dozen different strings in all."""
    return F.array(
        F.concat(F.lit(f"{kind} {strict} length "), F.least(F.floor(F.length(value) / 4), F.lit(10)).cast("string")),
        F.concat(F.lit(f"{kind} digits "), F.least(F.length(_digits(value)), F.lit(20)).cast("string")),
        F.concat(F.lit("before "), F.when(before == "", "start").when(before.rlike(r"\s$"), "space").when(before.rlike(r"[\p{L}\p{N}]$"), "word").otherwise("mark")),
        F.concat(F.lit("after "), F.when(after == "", "end").when(after.rlike(r"^\s"), "space").when(after.rlike(r"^[\p{L}\p{N}]"), "word").otherwise("mark")),
    )


def _pieces(text: Column, kind: str, strict: bool) -> Column:
    """(values, gaps): the matches of one pattern and what stands around them; null without any."""
    pattern = (STRICT if strict else LOOSE)[kind]
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: F.when(
        F.size(values) > 0, F.struct(values.alias("values"), F.split(text, pattern, -1).alias("gaps"))
    ))
    need = NEEDS.get((kind, strict))
    return found if need is None else F.when(F.contains(text, F.lit(need)), found)


def candidate_spans(text: Column) -> Column:
    """All proposed spans of a text with their votes, by kind and start; loose
    spans that touch a valid strict one are left out."""
    sources = [(kind, True) for kind in KINDS] + [(kind, False) for kind in KINDS if kind in LOOSE]
    names = [f"{kind}{int(strict)}" for kind, strict in sources]
    raw = F.struct(*[_pieces(text, *source).alias(name) for source, name in zip(sources, names, strict=True)])

    def lengths(found: Column, name: str) -> Column:
        each = F.transform(found[name].values, lambda value, i: F.length(F.get(found[name].gaps, i)) + F.length(value))
        return F.coalesce(each, F.array().cast("array<int>"))

    def placed(found: Column, ends: Column, place: int) -> Column:
        """The matches of one pattern; ``ends`` are the running sums of all patterns, one after the other."""
        (kind, strict), own = sources[place], found[names[place]]
        before = sum((F.coalesce(F.size(found[name].values), F.lit(0)) for name in names[:place]), F.lit(0))
        spans = let(F.struct(before.alias("first"), F.coalesce(F.get(ends, before - 1), F.lit(0)).alias("upto")), lambda at: F.transform(
            own.values, lambda value, i: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), (F.get(ends, at.first + i) - at.upto - F.length(value)).alias("start"),
                (F.get(ends, at.first + i) - at.upto).alias("end"), (_valid(kind, value) if strict else F.lit(False)).alias("base"),
                value.alias("value"), F.right(F.get(own.gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(own.gaps, i + 1), F.lit(1)).alias("after"),
            )
        ))
        return F.coalesce(F.when(own.isNotNull(), spans), F.array().cast(MATCH_TYPE))

    def labelled(kind: str, strict: bool, matches: Column, several: Column) -> Column:
        return F.transform(matches, lambda m: F.struct(
            m.kind.alias("kind"), m.start.alias("start"), m.end.alias("end"), m.base.alias("base"),
            _votes(kind, strict, m.value, m.before, m.after, several).alias("votes"),
            _shape(kind, strict, m.value, m.before, m.after).alias("shape"),
        ))

    def of_kind(matches: Column, kind: str) -> Column:
        return F.filter(matches, lambda m: m.kind == KINDS.index(kind))

    def split(found: Column, ends: Column) -> Column:
        matches = {source: placed(found, ends, place) for place, source in enumerate(sources)}
        return F.struct(
            *[matches[kind, True].alias(kind) for kind in KINDS], F.concat(*[matches[kind, False] for kind in LOOSE]).alias("loose"),
        )

    def judged(own: Column) -> Column:
        n = sum((F.size(own[kind]) for kind in KINDS), F.lit(0))
        base = F.filter(F.concat(*[own[kind] for kind in KINDS]), lambda s: s.base)
        return let(F.struct((n > 1).alias("several"), (n > 0).alias("any"), apart(own.loose, base).alias("free")), lambda known: F.concat(
            *[labelled(kind, True, own[kind], known.several) for kind in KINDS],
            *[labelled(kind, False, of_kind(known.free, kind), known.any) for kind in LOOSE],
        ))

    def all_of(found: Column) -> Column:
        sums = scan(F.concat(*[lengths(found, name) for name in names]), F.lit(0), lambda a, x: a + x)
        return let(let(sums, lambda ends: split(found, ends)), judged)

    def some(found: Column) -> Column:
        return sum((found[name].isNotNull().cast("int") for name in names), F.lit(0)) > 0

    # Texts without a match are done here.
    return let(raw, lambda found: F.when(some(found), all_of(found)).otherwise(F.array().cast(SPAN_TYPE))).cast(SPAN_TYPE)


def apart(loose: Column, base: Column) -> Column:
    """The spans of ``loose`` that touch none of ``base``, by start, by one sort
    of both and a scan from either side."""
    farthest = F.lit(-(1 << 31) + 1)

    def merged(both: Column) -> Column:
        marked = F.concat(
            F.transform(both.base, lambda s: F.struct(s.start.alias("start"), F.lit(0).alias("own"), s.end.alias("end"))),
            F.transform(both.loose, lambda m, i: F.struct(m.start.alias("start"), (i + 1).alias("own"), m.end.alias("end"))),
        )
        return let(F.sort_array(marked), lambda events: let(F.struct(
            # The last end of a base span that starts no later, and the first start of one that does.
            scan(F.transform(events, lambda e: F.when(e.own == 0, e.end).otherwise(0)), F.lit(0), F.greatest).alias("before"),
            scan(F.transform(F.reverse(events), lambda e: F.when(e.own == 0, -e.start).otherwise(farthest)), farthest, F.greatest).alias("after"),
        ), lambda near: F.transform(
            F.filter(
                F.transform(events, lambda e, i: F.when(
                    (e.own > 0) & (F.get(near.before, i) <= e.start) & (-F.get(near.after, F.size(near.after) - 1 - i) >= e.end), e.own
                )),
                lambda place: place.isNotNull(),
            ),
            lambda place: F.get(both.loose, place - 1),
        )))

    return let(F.struct(loose.alias("loose"), base.alias("base")), lambda both: (
        F.when((F.size(both.loose) > 0) & (F.size(both.base) > 0), merged(both)).otherwise(both.loose)
    ))


def features(span: Column) -> Column:
    """What the final classifier sees of a span: its kind, votes and shape."""
    votes = F.transform(span.votes, lambda vote, i: F.concat(F.lit("vote "), i.cast("string"), F.lit(" "), vote.cast("string")))
    return F.concat(F.array(F.concat(F.lit("kind "), span.kind.cast("string"))), votes, span.shape)


def _expectation_maximisation(patterns: Column) -> Column:
    """Prior by kind and, by labeler, the chances of a vote for (a: on personal
    data, b: on other spans), from an array of (kind, votes, n)."""
    kinds, labelers = F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), F.sequence(F.lit(0), F.lit(LABELERS - 1))
    state = "struct<prior:array<double>,a:array<double>,b:array<double>>"

    def total(rows: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, r: s + value(r))

    def step(model: Column) -> Column:
        weighed = F.transform(patterns, lambda r: F.struct(
            r.kind.alias("kind"), r.votes.alias("votes"), r.n.cast("double").alias("n"), belief(model, r.kind, r.votes).alias("p")
        ))

        def rate(rows: Column, j: Column, share: Callable[[Column], Column], yes: float) -> Column:
            # Two imaginary votes keep every rate off 0 and 1.
            for_it = total(rows, lambda r: F.when(F.get(r.votes, j) == 1, r.n * share(r)).otherwise(0.0))
            voted = total(rows, lambda r: F.when(F.get(r.votes, j) >= 0, r.n * share(r)).otherwise(0.0))
            return (for_it + 2 * yes) / (voted + 2.0)

        return let(weighed, lambda rows: F.struct(
            F.transform(kinds, lambda k: (
                (total(rows, lambda r: F.when(r.kind == k, r.n * r.p).otherwise(0.0)) + 1.0)
                / (total(rows, lambda r: F.when(r.kind == k, r.n).otherwise(0.0)) + 2.0)
            )).alias("prior"),
            F.transform(labelers, lambda j: rate(rows, j, lambda r: r.p, 0.8)).alias("a"),
            F.transform(labelers, lambda j: rate(rows, j, lambda r: 1.0 - r.p, 0.2)).alias("b"),
        ).cast(state))

    first = F.struct(
        F.array_repeat(F.lit(0.5), len(KINDS)).alias("prior"), F.array_repeat(F.lit(0.8), LABELERS).alias("a"),
        F.array_repeat(F.lit(0.2), LABELERS).alias("b"),
    ).cast(state)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), first, lambda model, _: step(model))


def belief(model: Column, kind: Column, votes: Column) -> Column:
    """The chance that a span with these votes is personal data."""
    prior = F.get(model.prior, kind)
    terms = F.transform(votes, lambda vote, j: (
        F.when(vote == 1, F.log(F.get(model.a, j) / F.get(model.b, j)))
        .when(vote == 0, F.log((1.0 - F.get(model.a, j)) / (1.0 - F.get(model.b, j)))).otherwise(0.0)
    ))
    odds = F.aggregate(terms, F.log(prior / (1.0 - prior)), lambda s, x: s + x)
    return 1.0 / (1.0 + F.exp(-odds))


def train(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (weights): the log odds each feature adds, learnt on all rows.

    Equal votes are counted first, at most 4 x 3^6 combinations, and features
    next, a few hundred strings, so what meets in one row does not grow with
    the documents.
    """
    spans = docs.select(F.explode(candidate_spans(F.coalesce(F.col(text), F.lit("")))).alias("span"))
    counted = spans.select(
        F.col("span.kind").alias("kind"), F.col("span.votes").alias("votes"), F.explode(features(F.col("span"))).alias("feature")
    ).groupBy("feature", "kind", "votes").agg(F.count("*").alias("n"))
    everything = counted.agg(F.sort_array(F.collect_list(F.struct("feature", "kind", "votes", "n"))).alias("rows"))
    # The feature "kind k" occurs once in every span, so its rows are the vote patterns.
    patterns = F.filter("rows", lambda r: r.feature.startswith("kind "))

    def weights(model: Column) -> Column:
        soft = F.transform("rows", lambda r: F.struct(
            r.feature.alias("feature"), r.n.cast("double").alias("n"), belief(model, r.kind, r.votes).alias("p")
        ))

        def odds(rows: Column, feature: Column) -> Column:
            own = F.filter(rows, lambda r: r.feature == feature)
            return F.log(
                (F.aggregate(own, F.lit(0.5), lambda s, r: s + r.n * r.p) / (total_of(rows, lambda r: r.p) + 1.0))
                / (F.aggregate(own, F.lit(0.5), lambda s, r: s + r.n * (1.0 - r.p)) / (total_of(rows, lambda r: 1.0 - r.p) + 1.0))
            )

        def total_of(rows: Column, share: Callable[[Column], Column]) -> Column:
            return F.aggregate(F.filter(rows, lambda r: r.feature.startswith("kind ")), F.lit(0.0), lambda s, r: s + r.n * share(r))

        def table(rows: Column) -> Column:
            names = F.array_distinct(F.transform(rows, lambda r: r.feature))
            prior = F.log((total_of(rows, lambda r: r.p) + 1.0) / (total_of(rows, lambda r: 1.0 - r.p) + 1.0))
            return F.map_from_arrays(
                F.concat(names, F.array(F.lit("prior"))), F.concat(F.transform(names, lambda f: odds(rows, f)), F.array(prior))
            )

        return let(soft, table)

    return everything.select(let(_expectation_maximisation(patterns), weights).alias("weights"))


def find_personal_data(docs: DataFrame, text: str = "text", out: str = "personal", weights: Column | None = None) -> DataFrame:
    """Add an array ``out`` of (kind, start, end, base), sorted: the spans of
    personal data, in code points, ends exclusive; kinds are numbers of ``KINDS``.

    Strict spans with a valid form are always there (``base``); others if the
    classifier believes in them.  ``weights`` is the row of ``train``; by default
    it is learnt on ``docs``.  A null or empty text has no spans.  Rows are
    independent once the weights are known: repeated rows agree, an empty table
    stays empty, extra columns are kept, one named like ``out`` is replaced.
    """
    learnt = train(docs, text).scalar() if weights is None else weights
    spans, model = free_names(docs, "spans", "model", beside=out)

    def accepted(span: Column) -> Column:
        score = F.aggregate(features(span), F.element_at(F.col(model), "prior"), lambda s, f: s + F.coalesce(F.try_element_at(F.col(model), f), F.lit(0.0)))
        return span.base | (score > 0)

    chosen = F.transform(F.filter(spans, accepted), lambda s: F.struct(
        s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.base.alias("base")
    ))
    proposed = docs.withColumns({spans: candidate_spans(F.coalesce(F.col(text), F.lit(""))), model: learnt})
    return proposed.withColumn(out, F.when(F.size(spans) > 0, F.sort_array(chosen)).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean>>"))).drop(spans, model)


def span_list(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of spans
    that overlap, the one that starts first, and of those the longest.

    The text is cut into pieces first, so that no cut walks it from its start.
    """
    size = 1024
    names = F.array(*[F.lit(f"<{kind.upper()}>") for kind in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("minus_end"), s.kind.alias("kind"))))

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        first = F.shiftright(start, 10)
        near = F.array_join(F.slice(pieces, first + 1, F.shiftright(end, 10) - first + 1), "")
        return F.substring(near, start % size + 1, end - start)

    def whole(pieces: Column, order: Column, upto: Column) -> Column:
        parts = F.transform(order, lambda s, i: let(F.coalesce(F.get(upto, i - 1), F.lit(0)), lambda begin: F.when(
            s.start >= begin, F.concat(cut(pieces, begin, s.start), F.get(names, s.kind))
        ).otherwise("")))
        last = F.element_at(upto, -1)
        return F.concat(F.array_join(parts, ""), let(last, lambda begin: F.when(
            F.shiftright(begin, 10) < F.size(pieces), F.substring(F.array_join(F.slice(pieces, F.shiftright(begin, 10) + 1, F.size(pieces)), ""), begin % size + 1, F.length(text))
        ).otherwise("")))

    parted = let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("pieces"), ordered.alias("order")), lambda own: let(
        scan(F.transform(own.order, lambda s: -s.minus_end), F.lit(0), F.greatest), lambda upto: whole(own.pieces, own.order, upto)
    ))
    return F.when(F.size(spans) > 0, parted).otherwise(text)

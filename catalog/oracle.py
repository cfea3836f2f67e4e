"""The registered queries in SQL, written from their definitions.

Only constants (bounds, word lists, prompt texts) are shared with the library.
"""

from __future__ import annotations

from catalog.queries import ACCUMULATION, BATCH, HEAD, MARKERS, MAX_TOKENS, NUMERAL_CAP, ORIGINALS, SAMPLE, SEQUENCE_BOUNDS, WIDE_CHARS
from catalog.tables import LEXICON, SHOTS
from loomtext import defaults as d


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, column: str) -> str:
    """SQL for a template with a column in place of {text}."""
    return " || ".join(quote(part) if i == 0 else f"{column} || {quote(part)}"
                       for i, part in enumerate(template.split("{text}")))


def gate(a: str, b: str, chars=d.PAIR_CHARS) -> str:
    lo, hi = chars
    return (
        f"(length({a}) between {lo} and {hi} and length({b}) between {lo} and {hi} and "
        f"length({a})::double / nullif(length({b}), 0)::double "
        f"between {d.PAIR_RATIO[0]}::double and {d.PAIR_RATIO[1]}::double)"
    )


def stripped(column: str) -> str:
    return f"trim({column}, {quote(d.WHITESPACE)})"


def rank(*parts: str, seed: int | str = d.SEED) -> str:
    joined = ", ".join(f"({p})::varchar" for p in (quote(str(seed)), *parts))
    return f"('0x' || substr(md5(concat_ws(':', {joined})), 1, 15))::bigint"


LAW = "'c' || (conv_id // 100) as law, conv_id::varchar as article"

# Articles as lists of paragraphs, in turn order.
ARTICLES = f"""
chunk as (
    select role, {LAW}, turn,
           list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, {quote(f"[^{d.WHITESPACE}]")})) as ps
    from conversations
),
art as (
    select role, law, article, flatten(list(ps order by turn)) as ps from chunk group by role, law, article
),
both_sides as (
    select r.law, r.article, r.ps as pr, k.ps as pk
    from art r join art k on r.law = k.law and r.article = k.article
    where r.role = 'user' and k.role = 'assistant'
),
zipped as (
    select law, article, 'paragraph' as unit, i - 1 as pos, pr[i] as ru, pk[i] as ky
    from (select *, unnest(range(1, len(pr) + 1)) as i from both_sides where len(pr) = len(pk))
),
whole as (
    select law, article, 'article' as unit, 0 as pos,
           coalesce(array_to_string(pr, ' '), '') as ru, coalesce(array_to_string(pk, ' '), '') as ky
    from both_sides where len(pr) <> len(pk)
)
"""

PAIRS = f"""
pair as (
    select 'c' || (u.conv_id // 100) as law, u.conv_id::varchar as article,
           u.conv_id, u.turn, u.text as ru, a.text as ky
    from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1
    where u.role = 'user' and a.role = 'assistant'
)
"""

PARTS = """
parts as (
    select p_partkey as k, 'Пункт ' || p_partkey || ': срок ' || p_size || ' дней.' as ru,
           p_partkey || '-пункт: мөөнөтү ' || p_size || ' күн.' as ky
    from part
)
"""

SPLIT = (
    "case when list_reduce(list_transform(string_split(sha256(law || ':' || article), ''), "
    f"lambda c: ('0x' || c)::int), lambda a, b: (a * 16 + b) % {d.VAL_MODULUS}, 0) % {d.VAL_MODULUS} = 0 "
    "then 'val' else 'train' end"
)

_rows = ", ".join(f"({i}, {quote(r)}, {quote(k)})" for i, (r, k) in enumerate(LEXICON, 1))
_targets = "[" + ", ".join(quote(k) for k in dict.fromkeys(k for _, k in LEXICON)) + "]"
_sources = "[" + ", ".join(quote(r) for r, _ in LEXICON) + "]"


def lexicon(pairs: str) -> str:
    """Mined pairs and their variants, from a subquery with ru and ky."""
    return f"""
lex(ord, lr, lk) as (values {_rows}),
forms as (
    select *, list_filter({_sources}, lambda f: contains(ru, f))[1] as fr,
           list_filter({_targets}, lambda f: contains(ky, f))[1] as fk
    from {pairs}
),
mined as (select forms.* from forms join lex on fr = lr and fk = lk),
substituted as (
    select mined.*, 0 as ord, ru as new_ru, ky as new_ky from mined
    union all
    select mined.*, lex.ord, replace(ru, fr, lr), replace(ky, fk, lk) from mined, lex where lk <> fk
)
"""


_digits = "[" + ", ".join(quote(n) for n in d.NUMERAL_DIGITS) + "]"
_words = ", ".join(f"({i}, {quote(r)}, {quote(k)})" for i, (r, k) in enumerate(d.NUMERALS, 1))


def numerals(pairs: str, key: list[str], cap: int | str = NUMERAL_CAP) -> str:
    """Candidates and their variants, from a subquery with ru, ky and a key."""
    keys = ", ".join(key)
    return f"""
words(ord, wr, wk) as (values {_words}),
found as (
    select * from (
        select *, list_filter({_digits}, lambda n:
            len(list_filter(regexp_extract_all(ru, '\\p{{Nd}}+'), lambda x: x = n)) = 1
            and len(list_filter(regexp_extract_all(ky, '\\p{{Nd}}+'), lambda x: x = n)) = 1)[1] as d
        from {pairs})
    where d is not null
),
chosen as (select * from found order by {rank(*key, seed=f'{d.SEED}:cap')}, {keys} limit {cap}),
drawn as (
    select chosen.*, ord, wr, wk,
           row_number() over (partition by {keys} order by {rank(*key, "ord")}, ord) as place
    from chosen, words
),
numeral as (
    select {keys}, ord,
           regexp_replace(ru, '(^|\\P{{Nd}})' || d || '(\\P{{Nd}}|$)', '\\1' || wr || '\\2') as ru,
           regexp_replace(ky, '(^|\\P{{Nd}})' || d || '(\\P{{Nd}}|$)', '\\1' || wk || '\\2') as ky
    from drawn where place <= {d.NUMERALS_PER_PAIR}
)
"""


SUMMARIES = """
summaries as (
    select doc_id, substr(text, instr(text, chr(10)) + 1) as text, substr(text, 1, instr(text, chr(10)) - 1) as summary
    from documents where instr(text, chr(10)) > 0
)
"""

NORMALISED = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')"


def held_grams(text: str, name: str) -> str:
    """Grams of each item, and how many of them some document holds."""
    return f"""
item_{name} as (select item_id, {words(text)} as a, least(len({words(text)}), 5) as n from benchmark),
gram_{name} as (select distinct item_id, array_to_string(a[i:i + n - 1], ' ') as gram
    from (select *, unnest(range(1, len(a) - n + 2)) as i from item_{name} where n > 0)),
line_{name} as (select {words(text)} as a from documents),
corpus_{name} as (select distinct array_to_string(a[i:i + n - 1], ' ') as gram
    from (select a, n, unnest(range(1, len(a) - n + 2)) as i from line_{name}, (select distinct n from item_{name} where n > 0))),
count_{name} as (select item_id, count(*) as grams, count(c.gram) as held
    from gram_{name} g left join corpus_{name} c on g.gram = c.gram group by item_id)
"""


_context = f"length(text) between {d.CONTEXT_CHARS[0]} and {d.CONTEXT_CHARS[1]}"
_corpus = f"text is not null and text <> '' and length(text) between {d.CORPUS_CHARS[0]} and {d.CORPUS_CHARS[1]}"

REQUESTS = """
requests as (
    select conv_id, turn, case when length(text) < 150 then 'ky2ru' else 'ru2ky' end as direction,
           ' ' || chr(10) || ' ' || text || ' ' || chr(10) || ' ' as text
    from conversations
    union all
    select conv_id, -1 - turn, case when length(text) < 150 then 'ky2ru' else 'ru2ky' end, ' ' || chr(10) || ' '
    from conversations where role = 'system'
)
"""

LINES = f"""
command as (
    select conv_id::varchar as session, 2 * turn as seq,
           case when (conv_id + turn) % 5 = 0 then ':ky' when (conv_id + turn) % 5 = 1 then ':ru'
                when (conv_id + 3 * turn) % 23 = 0 then ':q' when (conv_id + 3 * turn) % 23 = 1 then 'Exit' end as line
    from conversations
),
lines as (
    select * from command where line is not null
    union all select conv_id::varchar, 2 * turn + 1, {stripped('text')} from conversations
),
directed as (
    select *, coalesce(last_value(case line when ':ky' then 'ru2ky' when ':ru' then 'ky2ru' end ignore nulls)
        over (partition by session order by seq rows between unbounded preceding and 1 preceding), 'ky2ru') as direction
    from lines
),
asked as (select * from directed where line not in (':ky', ':ru', '')),
quits as (select session, min(seq) as stop from lines where line = ':q' group by session),
exits as (select session, min(seq) as stop from lines where line = '' or lower(line) in ('exit', 'quit') group by session),
translating as (
    select a.* from asked a left join quits q on a.session = q.session where q.stop is null or a.seq < q.stop
)
"""


def task(name: str) -> str:
    return f"Тапшырма: {name}\nТекст: {{text}}\nЖыйынтык:"


GROUNDED = filled(f"{d.SYSTEM}\n\n{task(d.TASK_SUMMARY)}", "text")
CORRUPT = filled(f"{d.SYSTEM}\n\n{task(d.TASK_CORRUPT)}", "text")
RAW = filled(f"{d.SYSTEM}\n\n{{text}}", "text")
ZERO = filled(f"{d.SYSTEM} {d.TASK_SUMMARY_2_3}\n\n{{text}}", "text")
_shot = "".join(task(d.TASK_SUMMARY_2_3).replace("{text}", c) + f" {a}\n\n" for c, a in SHOTS)
FEW = filled(f"{d.SYSTEM}\n\n{_shot}{task(d.TASK_SUMMARY_2_3)}", "text")

ASK = f"""
case when {stripped("text")} = '' then ''
     when direction = 'ky2ru' then {filled(d.TO_RUSSIAN, stripped("text"))}
     else {filled(d.TO_KYRGYZ, stripped("text"))} end
"""

PICKED = f"""
picked as (
    select doc_id, text, (row_number() over (order by doc_id) - 1)::int as pos from documents where {_context}
)
"""

_all_pairs = """
all_pairs as (
    select 'turn' as kind, conv_id as k, turn, ru, ky from pair
    union all select 'part', k, 0, ru, ky from parts
)
"""
_key = ["kind", "k", "turn"]
def mixture(cap: int | str = NUMERAL_CAP, originals: int | str = ORIGINALS) -> str:
    """The three components; "null" is no limit."""
    return f"""
{PAIRS}, {PARTS}, {_all_pairs}, {lexicon("all_pairs")}, {numerals("all_pairs", _key, cap)},
original as (select * from all_pairs order by {rank(*_key)}, kind, k, turn limit {originals}),
mixture as (
    select 'lexicon' as component, kind, k, turn, ord, new_ru as ru, new_ky as ky,
           unnest(range(1, {d.LEXICON_COPIES} + 1))::int as copy from substituted
    union all
    select 'numeral', kind, k, turn, ord, ru, ky, unnest(range(1, {d.NUMERAL_COPIES} + 1))::int from numeral
    union all
    select 'original', kind, k, turn, 0, ru, ky, 1 from original
)
"""


def words(column: str) -> str:
    return f"list_filter(string_split_regex(coalesce({column}, ''), '[ \t\n\r]+'), lambda w: w <> '')"


def grams(column: str, n: int) -> str:
    """All n-grams of a list of words."""
    return f"list_transform(range(1, len({column}) - {n - 2}), lambda i: array_to_string({column}[i:i + {n - 1}], ' '))"


def registry() -> dict[str, str]:
    wide = f"""with {ARTICLES}
        select law, article, unit, pos, ru, ky from zipped where {gate("ru", "ky", WIDE_CHARS)}
        union all select law, article, unit, pos, ru, ky from whole where {gate("ru", "ky", WIDE_CHARS)}"""
    return {
        "length_filter": f"select doc_id, length(text)::int as n from documents where {_context}",
        "cpt_corpus": f"select doc_id, text from documents where {_corpus}",
        "cpt_corpus_head": f"select doc_id, text from documents where {_corpus} order by doc_id limit {HEAD}",
        "cpt_corpus_eos": f"select doc_id, text || '</s>' as text from documents where {_corpus}",
        "article_paragraphs": f"""with {ARTICLES},
            mine as (select *, case role when 'user' then 'ru' when 'assistant' then 'ky' else 'en' end as lang from art)
            select law, article, lang, i - 1 as pos, ps[i] as paragraph
            from (select *, unnest(range(1, len(ps) + 1)) as i from mine)
            union all select law, article, lang, -1, '' from mine where len(ps) = 0""",
        "align_articles": f"with {ARTICLES} select law, article, len(pr) as n_ru, len(pk) as n_ky from both_sides",
        "align_paragraphs": f"with {ARTICLES} select law, article, pos, ru, ky from zipped",
        "align_pairs": f"""with {ARTICLES}
            select law, article, unit, pos, ru, ky from zipped where {gate("ru", "ky")}
            union all select law, article, unit, pos, ru, ky from whole where {gate("ru", "ky")}""",
        "align_pairs_wide": wide,
        "align_split": f"select *, {SPLIT} as split from ({wide})",
        "align_report": f"""with {ARTICLES}
            select 'articles_ru' as metric, count(*) as n from art where role = 'user'
            union all select 'articles_ky', count(*) from art where role = 'assistant'
            union all select 'articles_common', count(*) from both_sides
            union all select 'paragraph_pairs', count(*) from zipped where {gate("ru", "ky")}
            union all select 'article_pairs', count(*) from whole where {gate("ru", "ky")}
            union all select 'articles_skipped', count(*) from whole where coalesce(not {gate("ru", "ky")}, true)""",
        "pair_gate": f"with {PAIRS} select conv_id, turn, {gate('ru', 'ky')} as ok from pair",
        "hash_split": f"with {PAIRS} select conv_id, turn, {SPLIT} as split from pair",
        "split_report": f"""with {PAIRS} select split, count(*) as pairs, 2 * count(*) as examples
            from (select {SPLIT} as split from pair) group by split""",
        "lexicon_mine": f"with {PAIRS}, {lexicon('pair')} select conv_id, turn, fr, fk from mined",
        "lexicon_augment": f"""with {PAIRS}, {lexicon('pair')}
            select conv_id, turn, ord, new_ru as ru, new_ky as ky from substituted""",
        "numeral_candidates": f"with {PARTS}, {numerals('parts', ['k'])} select k, d, ru, ky from found",
        "numeral_augment": f"with {PARTS}, {numerals('parts', ['k'])} select k, ord, ru, ky from numeral",
        "sample_n": f"select doc_id from documents order by {rank('doc_id')}, doc_id limit {SAMPLE}",
        "augment_mixture": f"with {mixture('null', 'null')} select component, kind, k, turn, ord, ru, ky, copy from mixture",
        "mixture_report": f"with {mixture()} select component, count(*) as n from mixture group by component",
        "augmentation_report": f"""with {mixture()}
            select 'pairs' as metric, count(*) as n from all_pairs
            union all select 'mined', count(*) from mined
            union all select 'substituted', count(*) from substituted where ord > 0
            union all select 'candidates', count(*) from found
            union all select 'numeral_left_out', (select count(*) from found) - (select count(*) from chosen)
            union all select 'original_left_out', (select count(*) from all_pairs) - (select count(*) from original)
            union all select 'total', count(*) from mixture
            union all select component, count(*) from mixture group by component""",
        "augment_mixture_all": f"with {mixture('null', 'null')} select component, kind, k, turn, ord, ru, ky, copy from mixture",
        "sft_translate_examples": f"""with {PAIRS}
            select conv_id, turn, 'ky2ru' as direction,
                   {filled(d.TO_RUSSIAN, "ky")} || ' ' || ru || '</s>' as text from pair
            union all
            select conv_id, turn, 'ru2ky', {filled(d.TO_KYRGYZ, "ru")} || ' ' || ky || '</s>' from pair""",
        "sft_summary_pairs": f"""with {SUMMARIES}
            select doc_id, {GROUNDED} || ' ' || summary || '</s>' as text from summaries
            where length(text) between {d.ARTICLE_CHARS[0]} and {d.ARTICLE_CHARS[1]}
              and length(summary) between {d.SUMMARY_CHARS[0]} and {d.SUMMARY_CHARS[1]}""",
        "sft_hand_pairs": f"""with {SUMMARIES}
            select doc_id, {filled(f"{d.SYSTEM}{chr(10)}{chr(10)}{task(d.TASK_SUMMARY_2_3)}", "text")}
                   || ' ' || summary || '</s>' as text from summaries""",
        "prompt_zero_shot": f"select doc_id, {ZERO} as prompt from documents where {_context}",
        "prompt_few_shot": f"select doc_id, {FEW} as prompt from documents where {_context}",
        "prompt_variants": f"""
            select doc_id, 'grounded' as variant, {GROUNDED} as prompt from documents where {_context}
            union all select doc_id, 'corrupt', {CORRUPT} from documents where {_context}
            union all select doc_id, 'raw', {RAW} from documents where {_context}
            union all select doc_id, 'chat', {GROUNDED} from documents where {_context}""",
        "request_prompts": f"with {REQUESTS} select conv_id, turn, {ASK} as prompt from requests",
        "heldout_pick": f"with {PICKED} select doc_id, pos from picked where pos in (5, 6, 7)",
        "heldout_all": f"with {PICKED} select doc_id, pos from picked where pos < 5",
        "ab_outputs": f"select doc_id, md5({ZERO}) as out_zero, md5({FEW}) as out_one from documents where {_context}",
        "ab_picked": f"""with {PICKED} select doc_id, pos, md5({GROUNDED}) as out_grounded,
            md5({CORRUPT}) as out_corrupt from picked where pos in (5, 6, 7)""",
        "ab_stored": f"""select doc_id, md5({GROUNDED}) as out_grounded, md5({CORRUPT}) as out_corrupt
            from documents where {_context}""",
        "apply_model_all": "select doc_id, md5(text) as output from documents",
        "capped_answers": f"""select doc_id, case when coalesce(text, '') = '' then '' else substr(md5(text), 1, least(1 + length(text) % 32, {MAX_TOKENS})) end as answer,
            coalesce(length(text) > 0 and 1 + length(text) % 32 > {MAX_TOKENS}, false) as cut,
            case when coalesce(text, '') = '' then 0 else least(1 + length(text) % 32, {MAX_TOKENS}) end::int as tokens from documents""",
        "apply_model_errors": """select doc_id, case when contains(text, '|') then '' else md5(text) end as value,
            case when contains(text, '|') then 'bar in text' else '' end as error from documents""",
        "apply_model_dedup": "select doc_id, md5(text) as output from documents",
        "ab_identical": f"""select count(*) as n, count(*) filter (md5({GROUNDED}) = md5({CORRUPT})) as same
            from documents where {_context}""",
        "heldout_anti": "select item_id from benchmark b where not exists (select 1 from documents d where d.text = b.text)",
        "contamination": f"""with i as (select item_id, ' ' || array_to_string({words('text')}, ' ') || ' ' as phrase from benchmark
                where len({words('text')}) > 0),
            c as (select doc_id, ' ' || array_to_string({words('text')}, ' ') || ' ' as line from documents)
            select item_id, doc_id from i, c where contains(line, phrase)""",
        "copy_rate": f"""with {SUMMARIES}, w as (select doc_id, {words('summary')} as a, {words('text')} as b from summaries)
            select doc_id, len(list_distinct({grams('a', 3)}))::int as grams,
                   len(list_distinct(list_intersect({grams('a', 3)}, {grams('b', 3)})))::int as copied from w""",
        "fabricated_numbers": f"""with {SUMMARIES}, n as (select doc_id, regexp_extract_all(summary, '\\p{{Nd}}+') as a,
                regexp_extract_all(text, '\\p{{Nd}}+') as b from summaries)
            select doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(a, lambda x: not list_contains(b, x)))), ','), '')
                as invented from n""",
        "marker_language": f"""select lang, count(*) as n, count(*) filter (translate(text, '{MARKERS}', '') <> text) as marked
            from documents group by lang""",
        "length_profile": f"""select lang, count(*) as n, count(*) filter (length(text) < {d.CONTEXT_CHARS[0]}) as under,
            count(*) filter ({_context}) as kept, count(*) filter (length(text) > {d.CONTEXT_CHARS[1]}) as "over",
            sum(length(text))::bigint as chars, min(length(text))::int as shortest, max(length(text))::int as longest,
            {", ".join(f"quantile_disc(length(text), {q / 100})::int as q{q}" for q in (25, 50, 75, 95))}
            from documents group by lang""",
        "ratio_profile": f"""with {SUMMARIES}, pair as (select 'doc' as law, doc_id::varchar as article,
                length(summary)::double / nullif(length(text), 0) as ratio from summaries),
            placed as (select *, {SPLIT} as split from pair)
            select split, count(ratio) as n, {", ".join(f"quantile_disc(ratio, {q / 100}) as q{q}" for q in (25, 50, 75, 95))}
            from placed where ratio is not null group by split""",
        "containment": f"""with {held_grams('text', '')}, {held_grams(NORMALISED, '_normalised')}
            select item_id, coalesce(a.grams, 0) as grams, coalesce(a.held, 0) as held, a.held / a.grams as share,
                   coalesce(b.grams, 0) as grams_normalised, coalesce(b.held, 0) as held_normalised, b.held / b.grams as share_normalised
            from benchmark left join count_ a using (item_id) left join count__normalised b using (item_id)""",
        "seq_overflow": " union all ".join(f"""select {bound} as bound, count(*) as n,
            count(*) filter (len({words('text')}) > {bound}) as "over" from documents""" for bound in SEQUENCE_BOUNDS),
        "step_budget": f"""select count(*) as n, ceil(count(*) / {BATCH * ACCUMULATION}.0)::bigint as steps
            from documents where {_corpus}""",
        "lexicon_coverage": f"""with {PAIRS} {"".join(f"""{'' if i == 1 else ' union all'}
            select {i} as ord, count(*) filter (contains(ru, {quote(r)})) as n_ru, count(*) filter (contains(ky, {quote(k)})) as n_ky,
                count(*) filter (contains(ru, {quote(r)}) and contains(ky, {quote(k)})) as n_both from pair""" for i, (r, k) in enumerate(LEXICON, 1))}""",
        "serve_requests": f"""with {REQUESTS}, prompted as (select *, {ASK} as prompt from requests)
            select conv_id, turn, case when prompt = '' then '' else md5(prompt) end as value,
                   '' as error from prompted""",
        "session_direction": f"with {LINES} select session, seq, line, direction from asked",
        "session_take_while": f"""with {LINES} select l.session, l.seq, l.line
            from lines l left join exits e on l.session = e.session where e.stop is null or l.seq < e.stop""",
        "serve_chat": f"""with {LINES}
            select l.session, l.seq, md5({filled(f"{d.SYSTEM}{chr(10)}{chr(10)}{{text}}", "l.line")}) as answer
            from lines l left join exits e on l.session = e.session where e.stop is null or l.seq < e.stop""",
        "session_requests": f"with {LINES} select session, seq, line, direction from translating",
        "serve_sessions": f"""with {LINES}, t as (select session, seq, direction, line as text from translating)
            select session, seq, direction, md5({ASK}) as value from t""",
    }

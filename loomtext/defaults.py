"""Default parameters.  Everything here can be overridden by an argument."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Word lists, bounds and prompt formats that must be exactly
# these for results and training examples to be interchangeable.
# ---------------------------------------------------------------------------

# Corpus text length, both ends included.
CORPUS_CHARS = (200, 3000)
CONTEXT_CHARS = (300, 800)

# Article and summary lengths of a summarising example.
ARTICLE_CHARS = (300, 2000)
SUMMARY_CHARS = (30, 300)

# Length of either side of a translation pair, and source length / target length.
PAIR_CHARS = (40, 900)
PAIR_RATIO = (0.4, 2.5)

# One article in this many goes to validation.
VAL_MODULUS = 20

# Fractions in words: Russian form, Kyrgyz form, in priority order.
FRACTIONS = [
    ("одной четверти", "төрттөн бири"),
    ("одна четверть", "төрттөн бири"),
    ("одной трети", "үчтөн бири"),
    ("одна треть", "үчтөн бири"),
    ("двух третей", "үчтөн экиси"),
    ("две трети", "үчтөн экиси"),
    ("трех четвертей", "төрттөн үчү"),
    ("три четверти", "төрттөн үчү"),
    ("половины", "жарымы"),
    ("половина", "жарымы"),
    ("одной пятой", "бештен бири"),
    ("двух пятых", "бештен экиси"),
]

# Numerals in words: Russian, Kyrgyz.
NUMERALS = [
    ("двадцать", "жыйырма"),
    ("тридцать", "отуз"),
    ("сорок", "кырк"),
    ("пятьдесят", "элүү"),
    ("шестьдесят", "алтымыш"),
    ("семьдесят", "жетимиш"),
    ("восемьдесят", "сексен"),
    ("девяносто", "токсон"),
    ("сто", "жүз"),
]

# Numbers looked for as digits, in priority order.
NUMERAL_DIGITS = ["20", "30", "40", "50", "60", "70", "80", "90", "100"]

# Mixture: candidates taken, words drawn for each, copies of each component,
# original pairs mixed in, seed.
NUMERAL_BASE_PAIRS = 800
NUMERALS_PER_PAIR = 4
LEXICON_COPIES = 20
NUMERAL_COPIES = 3
ORIGINAL_MIX = 3000
SEED = 42

# Prompt formats.  {text} marks where the text goes.
SYSTEM = "Сен кыргыз тилинде гана жооп берүүчү жардамчысың. Казак тилинде эмес, так кыргыз тилинде жаз."
TASK_SUMMARY = "Төмөнкү тексттеги фактыларга гана таянып, кыргызча кыскача жыйынтыкта."
TASK_SUMMARY_2_3 = "Төмөнкү тексттеги фактыларга гана таянып, кыргызча 2-3 сүйлөм менен кыскача жыйынтыкта."
TASK_CORRUPT = (
    "Төмөнкү тексттин кыскача жыйынтыгын жаз, бирок атайылап так бир фактыны "
    "(сан, дата, ат же жер) тексттеги чындыкка карама-каршы келтир — калганы туура болсун."
)
TASK_LINE = "Тапшырма: "
TEXT_LINE = "Текст: "
ANSWER_LINE = "Жыйынтык:"
TO_RUSSIAN = "Тапшырма: Төмөнкү юридикалык текстти орус тилине так которуу.\nТекст: {text}\nКотормо:"
TO_KYRGYZ = "Тапшырма: Төмөнкү юридикалык текстти кыргыз тилине так которуу.\nТекст: {text}\nКотормо:"
TRANSLATE = {"ky2ru": TO_RUSSIAN, "ru2ky": TO_KYRGYZ}

# Session lines: what each command switches to, the direction before any
# command, and the lines that end a session.
COMMANDS = {":ky": "ru2ky", ":ru": "ky2ru"}
START_DIRECTION = "ky2ru"
TRANSLATOR_STOPS = (":q",)
CHAT_STOPS = ("exit", "quit")

# Characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# ---------------------------------------------------------------------------
# Choices of this library.
# ---------------------------------------------------------------------------

# End-of-text marker appended to training texts; pass the tokenizer's own.
EOS = "</s>"

# Rows of one key handled together when an ordered computation is cut into blocks.
BLOCK_ROWS = 1 << 16

"""Sentence units across languages and scripts, by statistics learned without labels.

One pass counts, for each language and for all together, which words open a paragraph or
follow an unambiguous end, and what follows each word that ends in a period.  Log-likelihood
ratios then name

* sentence starters: words met at the start of a unit far more often than elsewhere,
* abbreviations: words whose period is followed far more often than a true end by what doesn't
  start a sentence, or hardly ever ends a paragraph; those whose capitalised followers are
  hardly ever starters, or that never end anything, are title-like, such as "Dr.",
* collocations: words that follow a number with a period too often for chance ("5. Mai"),
* common words: openers that are written small elsewhere, which part "J. Smith" from "J. The".

A second pass cuts each text.  Blocks are parted by blank lines; list items and timed lines are
units of their own.  Within a block each period is classified by the learned statistics, other
marks by their context; quotations and parentheses are matched first and not cut inside.
Thai, which has no period, is cut at spaces, by starters where a space follows a number.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.runtime import Workspace

ANY = "*"
NUMBER = "##"
#: 1 % point of the chi-square distribution with one degree of freedom.
LIKELY = 6.63
#: Least share of its language's starts, periods or numbers that a learned word has.
LEAST_SHARE = 1 / 20_000

# Punctuation of the scripts covered.
STOPS = ".!?…。！？।؟۔॥።။។։｡．"
FIRM = "。！？।؟۔॥።။។։｡．"
OPEN_CLOSE = {"(": ")", "（": "）", "[": "]", "«": "»", "「": "」", "『": "』", "《": "》", "“": "”", "„": "“"}
CLOSING = ")）]»」』》”“\""
CLOSERS = set(CLOSING)
OPENERS = "([（«“„\"「『《¿¡'’‘"

_LINE = re.compile(r"\r\n|[\n\r\x85  ]")
_TOKEN = re.compile(r"\S+")
_BULLET = re.compile(r"\s*[-*•–—▪◦‣·]\s")
_NUMBERED = re.compile(r"\s*(?:\d{1,3}(?:\.\d{1,3})*[.)]|\d{1,3}(?:\.\d{1,3})+|\(?[a-zA-Z0-9]\))\s")
_TIMED = re.compile(r"\s*\[?\d+(?:[.:]\d+)*\s*[–—-]\s*\d+(?:[.:]\d+)*\s*s?\]?\s*:")
_STOP = re.compile(f"[{STOPS}]+")
_TOKEN_END = re.compile(rf"(\S*?)([{STOPS}]+)([{re.escape(CLOSING)}]*)(?=\s|\Z)")
_UNSPACED_START = re.compile(r"(?:\A|[。！？])([぀-ヿ㐀-鿿]{2})")
_INITIALS = re.compile(r"(?:[^\W\d_]\.[-‐]?)+")
_NUMERIC = re.compile(r"[\d.,:/]*\d[\d.,:/]*")
_PAIRED = re.compile("[" + re.escape("".join({*OPEN_CLOSE, *OPEN_CLOSE.values(), '"'})) + "]")
_THAI = re.compile(r"[\u0e00-\u0e7f]")
_SPACE = re.compile(r"\s+")
_BROKEN = re.compile(r"[^\W\d_][’'\w]|[^\W\d_]\s")


def thai(ch: str) -> bool:
    return "฀" <= ch <= "๿"


def unspaced(ch: str) -> bool:
    """A letter of a script that writes without spaces, Thai aside."""
    return "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or "豈" <= ch <= "﫿"


def composed(token: str) -> str:
    """With its accents as one letter each."""
    return token if token.isascii() else unicodedata.normalize("NFC", token)


def word_type(token: str) -> str:
    """What counts as one word: lower case without punctuation around; numbers are all alike.

    Scripts that don't part words have none to count; there it is the opening, of five letters
    in Thai and two in Chinese and Japanese.
    """
    core = composed(token).strip(OPENERS + CLOSING + ",;:" + STOPS)
    if not core:
        return ""
    if any(c.isdigit() for c in core):
        return NUMBER
    if thai(core[0]):
        return core[:5]
    if unspaced(core[0]):
        return core[:2]
    return core.lower()


def period_type(token: str) -> str:
    """The word before a single final period; inner periods are kept between single letters ("p.m", "j.-p")."""
    core = composed(token).lstrip(OPENERS)[:-1]
    if _NUMERIC.fullmatch(core):
        return NUMBER
    if any(c.isdigit() for c in core):
        return "#"
    parts = core.split(".")
    return (core if all(len(p.lstrip("-‐")) <= 2 for p in parts) else parts[-1]).lower()


def blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the parts no unit crosses: ``unit`` is a whole unit, ``prose`` is cut further."""
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    start = end = None
    listed = False
    for a, b in [*lines, (len(text), len(text))]:
        line = text[a:b]
        if not line.strip():
            if start is not None:
                yield ("unit" if listed else "prose"), start, end
            start, listed = None, False
            continue
        padded = line + " "
        marked = bool(_TIMED.match(line) or _BULLET.match(padded) or ((start is None or listed) and _NUMBERED.match(padded)))
        if marked and start is not None:
            yield ("unit" if listed else "prose"), start, end
            start = None
        if start is None:
            start, listed = a, marked
        end = b


def pairs(text: str, start: int, end: int) -> dict[int, int]:
    """Where each quotation or parenthesis opened in the block closes; unmatched marks don't count."""
    found: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    straight = None
    for m in _PAIRED.finditer(text, start, end):
        ch, i = m.group(), m.start()
        if ch == '"':
            if straight is None:
                straight = i
            else:
                found[straight] = i
                straight = None
            continue
        at = next((k for k in range(len(open_) - 1, -1, -1) if OPEN_CLOSE[open_[k][0]] == ch), None)
        if at is not None:
            found[open_[at][1]] = i
            del open_[at:]
        elif ch in OPEN_CLOSE:
            open_.append((ch, i))
    return found


def outermost(closes: dict[int, int]) -> list[tuple[int, int]]:
    """The pairs that lie in no other, in order."""
    out: list[tuple[int, int]] = []
    for o, c in sorted(closes.items()):
        if not out or o > out[-1][1]:
            out.append((o, c))
        elif c > out[-1][1]:
            out[-1] = (out[-1][0], c)
    return out


# ---------------------------------------------------------------- statistics


def case_of(token: str) -> str:
    """U, l or o: whether the first letter is a capital, a small one, or has no case."""
    first = token[:1]
    return "U" if first.isupper() else "l" if first.islower() else "o"


def count_text(text: str, lang: str, counts: Counter, tokens: dict[str, Counter], types: dict[str, str] | None = None) -> None:
    """Adds one text's counts: (lang, kind, word, follower, case) -> number, and its tokens by language.

    ``types`` remembers the word types of tokens from text to text.
    """
    types = {} if types is None else types

    def word_of(token: str) -> str:
        word = types.get(token)
        if word is None:
            word = types[token] = word_type(token)
        return word

    def opens(token: str) -> None:
        if word_of(token):
            counts[lang, "start", word_of(token), "", case_of(token.lstrip(OPENERS))] += 1

    for kind, start, end in blocks(text):
        if kind != "prose":
            continue
        words = text[start:end].split()
        tokens.setdefault(lang, Counter()).update(words)
        opens(words[0])
        if _THAI.search(text, start, end):
            for before, token in zip(words, words[1:]):
                if thai(token[0]):
                    if thai(before[-1]):
                        opens(token)
                    else:
                        counts[lang, "inside", word_of(token), "", "o"] += 1
        if any(unspaced(c) for c in words[0][:2]):
            for m in _UNSPACED_START.finditer(text, start, end):
                counts[lang, "start", m.group(1), "", "o"] += 1
                counts[lang, "word", m.group(1), "", "o"] += 1
        quoted, at = None, 0
        for m in _TOKEN_END.finditer(text, start, end):
            if quoted is None:
                quoted = outermost(pairs(text, start, end))
            stop = m.start(2)
            while at < len(quoted) and quoted[at][1] < stop:
                at += 1
            if at < len(quoted) and quoted[at][0] < stop:
                continue  # what is quoted ends no unit
            follow = _TOKEN.search(text, m.end(), end)
            if m.group(2) == ".":
                word = period_type(m.group(1) + ".")
                if not word:
                    continue
                if follow is None:
                    counts[lang, "last", word, "", "o"] += 1
                else:
                    after = follow.group().lstrip(OPENERS)
                    counts[lang, "period", word, word_of(after), case_of(after)] += 1
            elif follow is not None and not m.group(3) and m.group(2)[-1] != "." and m.group(1):
                opens(follow.group())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "kind", "word", "after", "case", "n"]

    def rows(counts: Counter, tokens: dict[str, Counter], types: dict[str, str]) -> pa.RecordBatch:
        for lang, own in tokens.items():
            for token, n in own.items():
                word = types.get(token)
                if word is None:
                    word = types[token] = word_type(token)
                if word:
                    counts[lang, "word", word, "", "o"] += n
                    if token.lstrip(OPENERS)[:1].islower():
                        counts[lang, "lower", word, "", "l"] += n
        keys = list(counts)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(5)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([counts[k] for k in keys], pa.int64())], names=names)

    counts, tokens, types = Counter(), {}, {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                count_text(text, lang or "", counts, tokens, types)
        if len(counts) + len(types) > 200_000:
            yield rows(counts, tokens, types)
            counts, tokens, types = Counter(), {}, {}
    yield rows(counts, tokens, types)


def ratio(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood ratio of ``k`` hits in ``n`` trials against the rate ``p``."""
    tiny = F.lit(1e-9)
    p = F.least(F.greatest(p, tiny), 1 - tiny)
    q = F.least(F.greatest(k / n, tiny), 1 - tiny)
    return 2 * (k * F.log(q / p) + (n - k) * F.log((1 - q) / (1 - p)))


def learn(documents: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, kind, word): the starters, abbreviations, title-like ones and collocations found.

    Counts cover every text whole.  A word needs significance, corrected for the number of words
    tested, an effect that doesn't depend on the size of the corpus, and a least share
    (LEAST_SHARE) of its language's starts or periods; so a language has at most 1 / LEAST_SHARE
    words of a kind, whatever the number of documents.  Numbers are never abbreviations; what
    follows an ordinal is a collocation.
    """
    ws = Workspace(documents.sparkSession, "sentences")
    counted = documents.select(text, F.coalesce(F.col(lang), F.lit("")).alias("lang")).mapInArrow(_count, "lang string, kind string, word string, after string, case string, n long")
    own = ws.save(counted.groupBy("lang", "kind", "word", "after", "case").agg(F.sum("n").alias("n")))
    every = own.groupBy("kind", "word", "after", "case").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(ANY))
    counts = ws.save(own.unionByName(every))
    of = lambda *kinds: counts.filter(F.col("kind").isin(*kinds))
    when = lambda kind, extra=F.lit(True): F.sum(F.when((F.col("kind") == kind) & extra, F.col("n")).otherwise(0))
    words = of("word", "lower", "start", "inside").groupBy("lang", "word").agg(
        when("word").alias("all"), when("lower").alias("lower"), when("start").alias("at"), when("start", F.col("case") == "l").alias("small"), when("inside").alias("inside")
    )
    words = ws.save(words.filter(F.col("word") != NUMBER))
    rates = words.groupBy("lang").agg(F.sum("all").alias("words"), F.sum("at").alias("starts"))
    rate = F.col("starts") / F.col("words")
    scored = words.filter("at >= 2").join(rates, "lang").filter((F.col("at") >= LEAST_SHARE * F.col("starts")) & (F.col("at") > F.col("inside")))
    odds = lambda p: p / F.greatest(1 - p, F.lit(1e-9))
    starter = (odds(F.col("at") / F.col("all")) >= 1.5 * odds(rate)) & (ratio(F.col("at"), F.col("all"), rate) > LIKELY)
    # what opens units and is written small elsewhere is a common word, no name
    common = (F.col("lower") >= 0.2 * F.col("all")) & (F.col("at") / F.col("all") >= 0.2 * rate)
    openers = scored.select("lang", "word", F.coalesce(starter, F.lit(False)).alias("starter"), common.alias("common"), (F.col("at") - F.col("small")).alias("fit"))
    openers = ws.save(openers.filter("starter or common"))
    # how often a true start looks odd: it opens with no starter, or with a small letter
    fits = openers.groupBy("lang").agg(F.sum("fit").alias("fit"))
    odd_rate = rates.join(fits, "lang", "left").select("lang", (1 - F.coalesce("fit", F.lit(0)) / F.greatest("starts", F.lit(1))).alias("odd_rate"))
    follow = of("period").join(openers.select("lang", F.col("word").alias("after"), F.lit(1).alias("starts")), ["lang", "after"], "left")
    known = F.col("starts").isNotNull() & (F.col("case") != "l")
    total_of = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    use = follow.filter(F.col("word") != NUMBER).groupBy("lang", "word").agg(
        F.sum("n").alias("mid"), total_of(known).alias("good"), total_of(F.col("case") == "U").alias("capitals"), total_of(F.col("case") == "l").alias("small"), total_of(known & (F.col("case") == "U")).alias("good_capitals")
    )
    last = of("last").filter(F.col("word") != NUMBER).groupBy("lang", "word").agg(F.sum("n").alias("last"))
    use = use.join(last, ["lang", "word"], "left").fillna(0, ["last"]).withColumn("total", F.col("mid") + F.col("last"))
    tested = use.groupBy("lang").agg(F.sum(F.when(F.col("mid") >= 3, 1).otherwise(0)).alias("tested"), F.sum("total").alias("periods"), (F.sum("last") / F.sum("total")).alias("end_rate"))
    use = ws.save(use.join(tested, "lang").join(odd_rate, "lang"))
    odd, total = F.col("mid") - F.col("good"), F.col("total")
    strict = lambda n: 2 * F.log(F.greatest(n, F.lit(1)) / 0.05)
    strange = (odd / total >= 0.25) & (odd / total >= F.least(2 * F.col("odd_rate"), F.lit(0.7))) & (ratio(odd, total, F.col("odd_rate")) > strict(F.col("tested")))
    # a word whose period hardly ever ends a paragraph, where those of its language often do
    never = (F.col("last") <= 0.1 * F.col("end_rate") * total) & (ratio(F.col("last"), total, F.col("end_rate")) > strict(F.col("tested")))
    # a language's verdicts are about its own words, not those of passages in another language
    everywhere = use.filter(F.col("lang") == ANY).select("word", F.col("total").alias("everywhere"))
    abbreviations = ws.save(use.filter((strange | never) & (F.col("total") >= LEAST_SHARE * F.col("periods"))).join(everywhere, "word").filter(total >= 0.3 * F.col("everywhere")))
    # in a script without case, what never ends a paragraph ends no unit
    uncased = (F.col("capitals") + F.col("small")) == 0
    title = ((F.col("capitals") >= 0.9 * F.col("mid")) & ((F.col("good_capitals") / F.greatest(F.col("capitals"), F.lit(1)) < 0.4) | never)) | (uncased & never)
    # an abbreviation of all languages together that is a word like any other in one of them
    shared = abbreviations.filter(F.col("lang") == ANY).select("word")
    plain = use.filter((F.col("total") >= 20) & (odd / total < 0.2) & (F.col("last") > 0) & (F.col("last") >= 0.5 * F.col("end_rate") * total)).join(shared, "word", "left_semi")
    # ordinals: the number's period is followed by the word far more often than its share of all words
    numbers = of("period").filter(F.col("word") == NUMBER)
    both = numbers.groupBy("lang", F.col("after").alias("word")).agg(F.sum("n").alias("both"))
    chance = both.join(words, ["lang", "word"]).join(numbers.groupBy("lang").agg(F.sum("n").alias("numbers")), "lang").join(rates, "lang").join(tested, "lang")
    after_number, expected = F.col("both") / F.col("all"), F.col("numbers") / F.col("words")
    # what opens units after other ends as well is no part of the ordinal
    opener = F.col("at") / F.greatest(F.col("all") - F.col("both"), F.lit(1))
    together = (
        (F.col("both") >= 3) & (after_number >= 0.3) & (after_number >= 5 * expected) & (opener < 0.5) & (F.col("at") < F.col("both"))
        & (F.col("both") >= LEAST_SHARE * F.col("numbers")) & (ratio(F.col("both"), F.col("all"), expected) > strict(F.col("tested")))
    )
    # a language that goes on in small letters after numbers far more often than after other ends has ordinals
    small = words.groupBy("lang").agg((F.sum("small") / F.greatest(F.sum("at"), F.lit(1))).alias("small"))
    goes_on = numbers.groupBy("lang").agg(F.sum(F.when(F.col("case") == "l", F.col("n")).otherwise(0)).alias("on"), F.sum("n").alias("numbers")).join(small, "lang")
    ordinal = (F.col("on") >= 3) & (F.col("on") / F.col("numbers") >= 3 * F.col("small")) & (ratio(F.col("on"), F.col("numbers"), F.col("small")) > LIKELY)
    out = (
        openers.filter("starter").select("lang", F.lit("starter").alias("kind"), "word")
        .unionByName(goes_on.filter(ordinal).select("lang", F.lit("ordinal").alias("kind"), F.lit(NUMBER).alias("word")))
        .unionByName(openers.filter("common").select("lang", F.lit("common").alias("kind"), "word"))
        .unionByName(abbreviations.select("lang", F.when(title, "title").otherwise("abbreviation").alias("kind"), "word"))
        .unionByName(plain.select("lang", F.lit("plain").alias("kind"), "word"))
        .unionByName(chance.filter(together).select("lang", F.lit("collocation").alias("kind"), "word"))
    )
    out = ws.save(out)
    for df in (own, counts, words, openers, use, abbreviations):
        ws.drop(df)
    return out


# ---------------------------------------------------------------- cutting


class Splitter:
    """Cuts texts by a learned model, a mapping of (lang, kind) to a set of words."""

    def __init__(self, model: dict[tuple[str, str], set[str]]):
        self.model = model

    def has(self, lang: str, kind: str, word: str) -> bool:
        return word in self.model.get((lang, kind), ()) or word in self.model.get((ANY, kind), ())

    def short(self, lang: str, word: str) -> str | None:
        """title, abbreviation or None: of the language itself, or of all unless the word is plain there."""
        if word in self.model.get((lang, "plain"), ()):
            return None
        return next((kind for kind in ("title", "abbreviation") if self.has(lang, kind, word)), None)

    def ends(self, text: str, start: int, end: int, lang: str) -> list[int]:
        """Where units of the prose block end, the block's own end left out."""
        found: list[int] = []
        closes = pairs(text, start, end)
        spans = outermost(closes)
        opened = {c: o for o, c in closes.items()}
        unit, at = start, start
        skip = 0

        def covered(i: int) -> bool:
            nonlocal skip
            while skip < len(spans) and spans[skip][1] <= i:
                skip += 1
            return skip < len(spans) and spans[skip][0] < i

        marks = [(m.start(), m.end()) for m in _STOP.finditer(text, start, end)]
        spaces = []
        if _THAI.search(text, start, end):
            spaces = [(m.start(), -m.end()) for m in _SPACE.finditer(text, start, end)]
        for a, b in sorted(marks + spaces):
            if a < at:
                continue
            cut = self._at_space(text, a, -b, unit, end, lang) if b < 0 else None
            if b < 0:
                if cut and not covered(a):
                    found.append(a)
                    unit = at = -b
                continue
            if covered(a):
                # the end of what is quoted may be the end of the unit
                stop = self._closed(text, b, end, opened, start)
                if stop == b or covered(stop):
                    continue
                cut = self._after_quote(text, opened[stop - 1], stop, unit, end, lang)
            else:
                stop = self._closed(text, b, end, opened, unit)
                cut = self._after_mark(text, a, b, stop, unit, end, lang)
            if cut:
                found.append(stop)
                unit = at = stop
        return found

    def _closed(self, text: str, at: int, end: int, opened: dict[int, int], since: int) -> int:
        """Past the marks that close what was opened; French ones have a space before them."""
        while True:
            i = at
            while i < end and text[i].isspace():
                i += 1
            if i < end and opened.get(i, -1) >= since and (i == at or text[i] == "»"):
                at = i + 1
            else:
                return at

    def _next(self, text: str, stop: int, end: int) -> tuple[str, str, bool]:
        """(first letter or digit after, its word, whether white space lies between)."""
        i = stop
        while i < end and text[i].isspace():
            i += 1
        spaced = i > stop
        while i < end and text[i] in OPENERS:
            i += 1
        m = _TOKEN.match(text, i, end)
        return (text[i] if i < end else ""), (word_type(m.group()) if m else ""), spaced

    def _at_space(self, text: str, a: int, b: int, unit: int, end: int, lang: str) -> bool:
        if b >= end or a <= unit or not thai(text[b]):
            return False
        if thai(text[a - 1]):
            return True
        if text[a - 1] in STOPS:
            return False
        return self.has(lang, "starter", text[b : b + 5])

    def _after_quote(self, text: str, opener: int, stop: int, unit: int, end: int, lang: str) -> bool:
        first, word, spaced = self._next(text, stop, end)
        if not first:
            return False
        begins = not text[unit:opener].strip()
        if not begins and text[stop:end].lstrip()[:1] in OPEN_CLOSE:
            return True
        if text[opener] in "(（[":
            return begins and not (first.islower() or first in ",;:،؛、，；")
        if first in ",;:،؛、，；–—-" or first.islower():
            return False
        if first.isupper() or first.isdigit() or first in "¿¡":
            return True
        if begins:
            return False
        return self.has(lang, "starter", text[stop : stop + 2] if unspaced(first) else word)

    def _after_mark(self, text: str, a: int, b: int, stop: int, unit: int, end: int, lang: str) -> bool:
        first, word, spaced = self._next(text, stop, end)
        if not first:
            return False
        run = text[a:b]
        if first in ",;:،؛、，；)]":
            return False
        if "…" in run or run.startswith(".."):
            return (first.isupper() or first.isdigit()) and spaced and text[stop:end].lstrip()[:1] not in "¿¡"
        if run[-1] in FIRM and run[-1] != "؟":
            return True
        if run != ".":
            if spaced:
                return stop == b or not first.islower()
            return first.isupper() or unspaced(first) or thai(first)
        k = a
        while k > unit and not text[k - 1].isspace():
            k -= 1
        before = text[k:a].lstrip(OPENERS)
        if not before:
            return False
        if not spaced:
            # the space is missing, or the period is part of a name, number or address
            plain = "." not in before and "_" not in before and "/" not in before and "@" not in before
            worded = before[-1].islower() and not any(c.isdigit() for c in before)
            counted = bool(_NUMERIC.fullmatch(before))
            rest = text[stop:end]
            return bool(first.isupper() and ((plain and worded) or counted) and _BROKEN.match(rest) and not rest[1:2].isupper() and self.short(lang, before.lower()) != "title")
        if len(before) == 1 and before.isalpha() and re.match(r"\s*[^\W\d_]\.", text[stop:end]):
            return False  # initials in a row, "z. B."
        word_before = period_type(before + ".")
        starter = self.has(lang, "starter", word)
        if word_before == NUMBER:
            if self.has(lang, "collocation", word):
                return starter and first.isupper()
            return starter or not first.islower() or NUMBER not in self.model.get((lang, "ordinal"), ())
        kind = self.short(lang, word_before)
        if _INITIALS.fullmatch(before + ".") and before[0].isupper() and kind != "abbreviation":
            # a name follows, unless it is a word that is written small elsewhere
            return first.isupper() and self.has(lang, "common", word)
        if kind is None and _INITIALS.fullmatch(before + "."):
            kind = "abbreviation"
        if kind is None:
            return True
        if kind == "title" or first.islower():
            return False
        # a script without case has only its starters to tell by
        return first.isupper() or (starter and not first.isdigit())

    def split(self, text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
        """(start, end) of each unit; none for null, empty and blank texts."""
        out: list[tuple[int, int]] = []
        for kind, start, end in blocks(text or ""):
            ends = self.ends(text, start, end, lang or "") if kind == "prose" else []
            for a, b in zip([start, *ends], [*ends, end]):
                part = text[a:b]
                left = len(part) - len(part.lstrip())
                if left < len(part):
                    out.append((a + left, a + len(part.rstrip())))
        return out


def split_sentences(documents: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, sent_no, start_char, end_char) of each unit of each text, in order.

    Offsets are code points from 0, the end exclusive, white space around left out; sent_no
    counts from 1.  Null, empty and blank texts have no unit.  A null ``lang`` is a language of
    its own, helped by the statistics of all.  Texts are cut whole; a row given twice comes out
    twice.  The model is what ``learn`` found significant, collected and sent to each executor;
    it holds words, not documents.
    """
    spark = documents.sparkSession
    model: dict[tuple[str, str], set[str]] = {}
    for r in learn(documents, text, lang).toLocalIterator():
        model.setdefault((r["lang"], r["kind"]), set()).add(r["word"])
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(sent.value)
        for batch in batches:
            keys, numbers, starts, ends = [], [], [], []
            for k, t, code in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for n, (a, b) in enumerate(splitter.split(t, code), 1):
                    keys.append(k)
                    numbers.append(n)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.column(0).type), *(pa.array(x, pa.int32()) for x in (numbers, starts, ends))], names=["key", "sent_no", "start_char", "end_char"]
            )

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(key, text, lang).mapInArrow(run, f"key {kind}, sent_no int, start_char int, end_char int")
    return out.withColumnRenamed("key", key)

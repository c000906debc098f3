"""Spellings of names that mean the same person or organisation.

Each spelling is read into tokens: given name, family name, or the parts and the kind of an
organisation; honorifics, roles, credits and legal forms are left out.  A symmetric-delete
index on the tokens (each token under itself and under itself less any one letter) brings
spellings together that are one edit apart; what they may stand for, an initial, an abbreviation
or a familiar form, is part of the key, so a family name that many have is no crowd.  Candidates
are aligned by the cheapest assignment of tokens.  A short form is linked only if it fits one
person of that family name; relatives stay apart.  Links are closed by connected components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.components import connected_components
from trellis.runtime import Workspace

# Familiar forms of given names.
FAMILIAR = {
    "abigail": "abby gail abbie", "alexandra": "alex lexi sasha sandra alexa", "alexander": "alex sasha xander", "andrew": "andy drew",
    "anthony": "tony ant", "arabella": "bella belle", "augustine": "gus augie", "barnaby": "barney", "bartholomew": "bart barty",
    "beatrice": "bea trixie", "benjamin": "ben benji", "cassandra": "cass cassie sandra", "catherine": "cathy kate", "charles": "charlie chuck",
    "charlotte": "lottie charlie", "christopher": "chris kit topher", "clementine": "clem clemmie tina", "cordelia": "delia cordy", "daniel": "dan danny",
    "david": "dave davy", "desmond": "des dez", "dimitri": "dima mitya", "dominic": "dom nic", "dorothea": "dora thea dot",
    "edward": "ed eddie ned ted", "eleanor": "nell ellie nora lena", "elizabeth": "liz beth lizzie betty eliza", "emmanuel": "manny manu",
    "evangeline": "evie eva lina", "ferdinand": "ferdi nand", "fitzgerald": "fitz gerry", "francesca": "fran cesca frankie", "frederick": "fred freddie",
    "gabriela": "gabi gabby", "genevieve": "gen eve viv", "georgina": "gina georgie", "gregory": "greg greggo", "guinevere": "gwen gwinnie",
    "harrison": "harry haz", "henrietta": "etta hettie hetty", "henry": "harry hank", "humphrey": "huff hum", "imogen": "immy", "ingeborg": "inge inga",
    "isabella": "izzy bella isa", "jacqueline": "jackie jacqui", "james": "jim jimmy jamie", "jeremiah": "jerry jem", "john": "jack johnny",
    "jonathan": "jon jonny nathan", "joseph": "joe joey", "josephine": "josie jo fina", "katherine": "kate kathy kat katie kit", "kenneth": "ken kenny",
    "kimberly": "kim kimmy", "lawrence": "larry laurie laz", "leonardo": "leo nardo", "lucinda": "lucy cindy linda", "magdalena": "magda lena maggie",
    "margaret": "maggie peggy peg meg rita", "marguerite": "margot rita", "matthew": "matt matty", "maximilian": "max maxi", "michael": "mike mick mikey",
    "mitchell": "mitch", "natalia": "talia nat natty tasha", "nathaniel": "nate nat natty", "nicholas": "nick nico", "octavia": "tavy tavia",
    "oliver": "ollie noll", "ophelia": "opie phelie", "patricia": "pat trish patty tricia", "patrick": "pat paddy", "penelope": "penny nell",
    "percival": "percy perce", "philippa": "pippa pip", "philip": "phil pip", "quentin": "quin", "raphael": "rafe rafa", "rebecca": "becky becca bex",
    "richard": "rick dick rich", "robert": "rob bob bert bobby", "roderick": "rod roddy", "rosalind": "ros roz linda", "samuel": "sam sammy",
    "sebastian": "seb bastian", "seraphina": "sera fina", "stephanie": "steph stevie", "stephen": "steve stevie", "susannah": "susie sue zuzu",
    "tabitha": "tabby bitha", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim timmo", "umberto": "berto umbo", "ursula": "ursa ulla",
    "valentina": "val tina", "veronica": "ronnie vero", "victoria": "tori vicky vic", "vincent": "vince vinny", "walter": "walt wally",
    "wilhelmina": "mina willa billie", "william": "will bill billy", "winifred": "winnie freda", "xavier": "xavi zavy zav", "ximena": "mena xime",
    "yevgenia": "zhenya genya", "yolanda": "yoli landa", "zachary": "zach zack zak", "zebedee": "zeb zed", "zephaniah": "zeph zeff",
}
# What isn't part of a name.
HONORIFICS = frozenset("mr mrs ms miss mx dr prof sir dame".split())
PARTICLES = frozenset("van von der den de di da del la le du dos".split())
GENERATIONS = frozenset("jr sr ii iii".split())
LEGAL = frozenset("ltd limited inc llc gmbh pty plc co corp company".split())
KINDS = ("photography", "collective", "studio", "films", "productions", "workshop", "floral", "agency", "gallery")
NOBODY = frozenset(
    "unknown various staff team guest supplied tbc tba none nobody anonymous anon null nil model talent in-house inhouse crew model hand-model".split()
) | {"n/a", "na", "?", "-", "see notes", "hand model", "the crew", "the team", "not known", "no credit", "not applicable", "in house", "stock", "self"}

_LEAD = re.compile(r"^(?:©|\(c\)|photo(?:graph)?(?:y|er|s)?\s*(?:by\b|:|-|–)|photo\s+(?=[A-Z])|credits?\s*[:\-–]|courtesy of\b|by\b|styled by\b|©\s*)\s*", re.I)
_ROLE = re.compile(r"\s*[(\[][^)\]]*[)\]]\s*$")
_LEGAL_END = re.compile(r"[\s,]+(?:GmbH|LLC|Ltd|Inc|PLC|(?:Pty )?Ltd)\.?$", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SHORT_FORMS = {short: [f for f, forms in FAMILIAR.items() if short in forms.split()] for forms in FAMILIAR.values() for short in forms.split()}


def plain(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def near(a: str, b: str) -> bool:
    """At most one letter changed, added, left out or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def deletes(token: str, least: int = 5) -> list[str]:
    """The token and, if it is long enough to be mistyped safely, itself less any one letter."""
    return list(dict.fromkeys([token, *(token[:i] + token[i + 1 :] for i in range(len(token)) if len(token) >= least)]))


def kind_of(word: str) -> str | None:
    """The kind of organisation that a word, whole, mistyped or abbreviated, names."""
    w = "studio" if word == "st." else word.rstrip(".")
    bones = w[:1] + re.sub("[aeiou]", "", w[1:])
    for kind in KINDS:
        full = kind[:1] + re.sub("[aeiou]", "", kind[1:])
        if near(w, kind) or near(w, kind + "s") or near(w + "s", kind) or (len(w) >= 4 and kind.startswith(w.rstrip("s"))) or (len(w) >= 3 and word.endswith(".") and kind.startswith(w)):
            return kind
        if len(bones) >= 3 and (bones == full or (len(bones) >= 4 and near(bones, full))):
            return kind
        if len(w) >= 8 and (w[:6] == kind[:6] or near(w.replace("ph", "f"), kind.replace("ph", "f"))):
            return kind
    return None


def cost(token: str, other: str) -> int:
    """What it takes for a given name to stand for another: 0 the same, 1 an edit, 2 a familiar form, 3 shortened."""
    a, b = token.rstrip("."), other.rstrip(".")
    if a == b:
        return 0
    if len(a) >= 5 and len(b) >= 5 and near(a, b):
        return 1
    if b in _SHORT_FORMS.get(a, ()) or a in _SHORT_FORMS.get(b, ()):
        return 2
    short, long = sorted((a, b), key=len)
    if len(short) == 1 and long.startswith(short):
        return 3
    if len(short) >= 2 and len(long) >= len(short) + 2 and (long.startswith(short) or (len(short) >= 3 and long.endswith(short))):
        return 3
    return 99


def align(one: list[str], two: list[str]) -> int:
    """The least total cost of assigning the tokens of the shorter list to tokens of the other."""
    few, many = sorted((one, two), key=len)
    if not few:
        return 99
    return min(sum(cost(a, b) for a, b in zip(few, choice)) for choice in permutations(many, len(few)))


class Reader:
    """Reads spellings; ``given`` are the given names known besides the familiar forms."""

    def __init__(self, given: set[str]):
        self.given = given | set(FAMILIAR) | set(_SHORT_FORMS)

    def is_given(self, word: str) -> bool:
        return word.rstrip(".") in self.given

    def read(self, spelling: str) -> list[tuple[str, str, str]]:
        """(class, given name or kind, key): the ways to read it; none for what names nobody."""
        text = plain(spelling).strip().strip("\"'").strip()
        while True:
            cut = _ROLE.sub("", _LEAD.sub("", text)).strip()
            if cut == text:
                break
            text = cut
        low = re.sub(r"\s+", " ", text.lower())
        if not re.search(r"[a-z]", low) or low in NOBODY or re.fullmatch(r"(?:model|talent|guest|staff|crew)s? ?\d*", low):
            return []
        if text.startswith("@"):
            return self._joined(re.sub(r"[^a-z]", "", low))
        return self._organisation(text) or self._person(text)

    def _joined(self, word: str) -> list[tuple[str, str, str]]:
        for kind in (*KINDS, "company"):
            if word.endswith(kind) and len(word) > len(kind) + 3:
                core = word[: -len(kind)]
                if kind == "company":
                    core, kind = core.removesuffix("floral"), "floral"
                return [("whole", kind, core)]
        # a given name that begins the word, the longest first
        for n in range(len(word) - 3, 2, -1):
            if word[:n] in self.given:
                rest = word[n:]
                keys = [rest, *(rest[len(p) :] for p in sorted(PARTICLES) if rest.startswith(p) and len(rest) > len(p) + 3)]
                return [("person", word[:n], k) for k in keys]
        return []

    def _organisation(self, text: str) -> list[tuple[str, str, str]]:
        text = _LEGAL_END.sub("", text)
        words = [w for w in re.split(r"\s*[&+]\s*|\s+and\s+|[\s/,\-]+", _CAMEL.sub(" ", text)) if w]
        low = [w.lower() for w in words]
        together = bool(re.search(r"[&+]|\band\b", text, re.I))
        kinds = [k for k in map(kind_of, low) if k]
        if "work" in low and "shop" in low:
            kinds.append("workshop")
        if not kinds and not together:
            return []
        core = [w.rstrip(".") for w in low if not kind_of(w) and w.rstrip(".") not in LEGAL | {"the", "and", "work", "shop", ""}]
        if not core:
            return []
        if len(core) == 1:
            return [("whole", kinds[0] if kinds else "", core[0])]
        return [("organisation", kinds[0] if kinds else "", "|".join(sorted(core)))]

    def _person(self, text: str) -> list[tuple[str, str, str]]:
        first, comma, second = text.partition(",")
        if comma and second.strip().rstrip(".").lower() in GENERATIONS:
            text, comma = first, ""
        if comma:
            text = f"{second.strip()} {first.strip()}"
        words = [w.lower() for w in re.split(r"\s+", _CAMEL.sub(" ", text.replace("-", "") if "-" in text else text)) if w]
        spread: list[str] = []
        for w in words:
            letters = re.fullmatch(r"(?:[a-z]\.)+[a-z]?\.?", w)
            spread += [w[0]] if letters else [re.sub(r"[^a-z.]", "", w.replace("0", "o"))]
        words = [w for w in spread if w and w.rstrip(".") not in HONORIFICS | GENERATIONS]
        # a short word between two others that is a particle, or one edit from it, isn't the name
        words = [w for i, w in enumerate(words) if i == 0 or not (w in PARTICLES or (i + 1 < len(words) and 2 <= len(w) <= 4 and any(near(w, p) for p in PARTICLES if len(p) >= len(w) - 1)))]
        while len(words) > 2 and (words[0] in PARTICLES or (not self.is_given(words[0]) and len(words[0]) == 2 and "." not in words[0])):
            words = words[1:]
        if not words:
            return []
        if len(words) == 1:
            w = words[0].rstrip(".")
            return self._joined(w) if len(w) >= 8 and w not in self.given else [("single", "", w)]
        head, tail = words[0], words[-1]
        if not comma and not self.is_given(head) and len(head.rstrip(".")) > 1:
            stripped = next((head[: -len(p)] for p in sorted(PARTICLES, key=len, reverse=True) if head.endswith(p) and head[: -len(p)] in self.given), None)
            if stripped:
                words[0] = stripped
            elif self.is_given(tail) and not head.endswith("."):
                words = [tail, *words[:-1]]
        family = "".join(w.rstrip(".") for w in words[1:] if len(w.rstrip(".")) > 1) or words[-1].rstrip(".")
        out = [("person", words[0] if len(words[0].rstrip(".")) > 1 else words[0].rstrip("."), family)]
        if not comma and len(words) == 2 and not self.is_given(head) and len(head) > 2 and not head.endswith("."):
            out.append(("organisation", "", "|".join(sorted(w.rstrip(".") for w in words))))
        return out


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, rest): the first and the other words of spellings that look like a given and a family name."""
    for batch in batches:
        found = [re.fullmatch(r"([A-Z][a-z]{2,}) ((?:[a-z]{2,3} )?[A-Z][\w-]{3,})", plain(s)) for s in batch.column(0).to_pylist()]
        rows = [(m.group(1).lower(), m.group(2).lower().replace("-", "")) for m in found if m]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["word", "rest"])


def _hints(given: str) -> list[str]:
    """What a given name may be met by: itself, its initial, its beginning and its end."""
    return ["f:" + given, "i:" + given[0], "p:" + given[:2], "p:" + given[:3], "s:" + given[-3:], "s:" + given[-4:]]


def _asks(given: str, known: set[str]) -> list[str]:
    """What a short form looks for; none for a given name in full, such as those of ``known``."""
    g = given.rstrip(".")
    if len(g) == 1:
        return ["i:" + g]
    asks = ["f:" + f for f in _SHORT_FORMS.get(g, ())]
    if given.endswith(".") or (g not in FAMILIAR and g not in known and len(g) <= 5):
        asks.append("p:" + g[:3] if len(g) >= 3 else "p:" + g)
        if not given.endswith(".") and len(g) >= 3:
            asks.append("s:" + g[-4:] if len(g) >= 4 else "s:" + g)
    return asks


def linked_spellings(spellings: DataFrame, name: str) -> DataFrame:
    """(spelling, group_id) of each spelling that has another spelling of its own entity.

    Spellings count once, without white space around.  Null and blank ones, and placeholders
    that name nobody, have no group.  A short form that fits several people of a family name is
    left unlinked.  An empty table gives an empty result.
    """
    spark = spellings.sparkSession
    ws = Workspace(spark, "names")
    bare = F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", "")
    distinct = ws.save(spellings.select(bare.alias("spelling")).filter("spelling <> ''").distinct())
    # given names: words before many different family names; they are a language's, not the rows'
    words = ws.save(distinct.mapInArrow(_first_words, "word string, rest string").distinct())
    counted = words.groupBy("word").count().filter("count >= 3")
    given = {r["word"] for r in counted.select("word").toLocalIterator()}
    sent = spark.sparkContext.broadcast(given)
    # short ones are names in full, not short forms, if most of their families have no longer name they could stand for
    longer = words.select(F.col("word").alias("long"), "rest")
    shorter = words.filter("length(word) <= 5").join(longer, "rest")
    shorter = shorter.filter((F.length("long") >= F.length("word") + 2) & (F.col("long").startswith(F.col("word")) | F.col("long").endswith(F.col("word"))))
    covered = shorter.groupBy("word").agg(F.count_distinct("rest").alias("covered"))
    own = counted.filter("length(word) <= 5").join(covered, "word", "left").filter("coalesce(covered, 0) * 2 < count")
    full = spark.sparkContext.broadcast({r["word"] for r in own.select("word").toLocalIterator()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            rows = [(s, *form) for s in batch.column(0).to_pylist() for form in reader.read(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["spelling", "class", "given", "key"])

    forms = ws.save(distinct.mapInArrow(read, "spelling string, class string, given string, key string"))
    named = forms.withColumn("node", F.concat_ws("\x1f", F.concat(F.lit("\x1f"), F.col("class")), "given", "key"))
    to_nodes = named.select(F.col("spelling").alias("src"), F.col("node").alias("dst"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(role, place, node, given, key): where each node of a person or an organisation is met."""
        known = full.value
        for batch in batches:
            rows = []
            for n, c, g, k in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c == "person":
                    bare_ = g.rstrip(".")
                    short = _asks(g, known)
                    whole = len(bare_) > 1 and not g.endswith(".")
                    for d in deletes(k):
                        if whole:
                            rows.append(("same", f"g\x1f{bare_}\x1f{d}", n, g, k))
                        rows += [("short", f"{a}\x1f{d}", n, g, k) for a in short]
                        # a familiar form is no full name to be short for
                        if whole and (bare_ in FAMILIAR or bare_ not in _SHORT_FORMS):
                            rows += [("full", f"{h}\x1f{d}", n, g, k) for h in _hints(bare_)]
                    if whole:
                        rows += [("same", f"k\x1f{k}\x1f{d}", n, g, k) for d in deletes(bare_)]
                elif c == "organisation":
                    parts = k.split("|")
                    for i, part in enumerate(parts):
                        rest = "|".join(parts[:i] + parts[i + 1 :])
                        rows += [("part", f"{rest}\x1f{d}", n, g, k) for d in deletes(part, 4)]
                    for order in permutations(parts) if len(parts) <= 3 else [parts]:
                        rows += [("part", f"w\x1f{d}", n, g, k) for d in deletes("".join(order))]
                elif c == "whole":
                    rows += [("part", f"w\x1f{d}", n, g, k) for d in deletes(k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=["role", "place", "node", "given", "key"])

    nodes = named.select("node", "class", "given", "key").distinct()
    places = ws.save(nodes.mapInArrow(index, "role string, place string, node string, given string, key string"))
    side = lambda role, x: places.filter(F.col("role") == role).select("place", *(F.col(c).alias(c + x) for c in ("node", "given", "key")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps the candidates whose tokens align, with the cost."""
        for batch in batches:
            a, b, ga, gb, ka, kb = (batch.column(i).to_pylist() for i in range(6))
            keep, price = [], []
            for i in range(len(a)):
                if "|" in ka[i] or "|" in kb[i] or ga[i] in KINDS or gb[i] in KINDS:
                    # one edit in all, the parts in any order
                    pa_, pb_ = ka[i].split("|"), kb[i].split("|")
                    if len(pa_) == len(pb_):
                        edits = min(sum(99 if not near(x, y) else x != y for x, y in zip(pa_, order)) for order in permutations(pb_))
                    else:
                        whole = [[k] if len(p) == 1 else ["".join(o) for o in permutations(p)] for k, p in ((ka[i], pa_), (kb[i], pb_))]
                        edits = min(99 if not near(x, y) else x != y for x in whole[0] for y in whole[1])
                    total = int(edits)
                else:
                    family = 0 if ka[i] == kb[i] else 1 if min(len(ka[i]), len(kb[i])) >= 4 and near(ka[i], kb[i]) else 99
                    total = 10 * family + align([ga[i]], [gb[i]])
                if total <= 13:
                    keep.append(i)
                    price.append(total)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(price, pa.int32())], names=["a", "b", "price"])

    def checked(pairs: DataFrame) -> DataFrame:
        return pairs.select("node_a", "node_b", "given_a", "given_b", "key_a", "key_b").distinct().mapInArrow(check, "a string, b string, price int")

    same = side("same", "_a").join(side("same", "_b"), "place").filter("node_a < node_b")
    # an edit in the given and one in the family name together are another name
    firm = checked(same).filter("price in (0, 1, 10)").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    part = side("part", "_a").join(side("part", "_b"), "place").filter("node_a < node_b")
    kinds = ws.save(checked(part.filter("given_a = given_b or given_a = '' or given_b = ''")))
    typed = kinds.filter(F.split("a", "\x1f")[2] == F.split("b", "\x1f")[2]).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    edges = ws.save(to_nodes.unionByName(firm).unionByName(typed))
    first = ws.save(connected_components(edges))
    # short forms and organisations without their kind: linked where just one entity fits best
    shorts = checked(side("short", "_a").join(side("full", "_b"), "place").filter("node_a <> node_b"))
    untyped = kinds.filter(F.split("a", "\x1f")[2] != F.split("b", "\x1f")[2])
    bare_first = F.split("a", "\x1f")[2] == ""
    untyped = untyped.select(F.when(bare_first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(bare_first, F.col("b")).otherwise(F.col("a")).alias("b"), "price")
    loose = ws.save(shorts.unionByName(untyped))
    level = (F.col("price") / 10).cast("int")

    def fitting(loose: DataFrame, groups: DataFrame) -> DataFrame:
        """(src, dst) of those that fit one group best."""
        best = loose.groupBy("a").agg(F.min(level).alias("level"))
        fits = loose.join(best, "a").filter(level == F.col("level")).join(groups.withColumnRenamed("id", "b"), "b")
        one = fits.groupBy("a").agg(F.min("group_id").alias("to"), F.max("group_id").alias("also"), F.min("b").alias("b")).filter(F.col("to") == F.col("also"))
        return one.select(F.col("a").alias("src"), F.col("b").alias("dst"))

    # a short word may be a name in full or a short form; initials and abbreviations choose once that is settled
    cut = F.split("a", "\x1f")[1].eqNullSafe("person") & ((F.length(F.split("a", "\x1f")[2]) == 1) | F.split("a", "\x1f")[2].endswith("."))
    settled = ws.save(edges.unionByName(fitting(loose.filter(~cut), first)))
    more = fitting(loose.filter(cut), ws.save(connected_components(settled)))
    every = ws.save(settled.unionByName(more))
    groups = connected_components(every).filter(~F.col("id").startswith("\x1f"))
    out = groups.select(F.col("id").alias("spelling"), "group_id")
    return out

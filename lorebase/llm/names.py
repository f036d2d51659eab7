"""Variant spellings of the names of people and groups."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.buckets import bucket_pairs, crowded_members
from lorebase.llm.canon import edits
from lorebase.operators.components import connected_components
from lorebase.session import stage

#: Given names and short forms in general use, in several languages. No order of words and no
#: block rests on it; a name without short forms has no place here. Fixed values.
NICKNAMES = {
    "abigail": "abby gail", "albert": "al bert albie", "alexander": "alex al sandy sasha xander lex alec", "alexandra": "alex sandra sasha lexi",
    "alfred": "alf alfie fred", "amara": "mara", "anastasia": "ana nastya stasya tasia", "andre": "dre", "andrew": "andy drew", "anthony": "tony ant",
    "antonio": "toni tonio", "arthur": "art artie", "augustin": "gus august", "barbara": "barb babs", "bartholomew": "bart barry", "benjamin": "ben benny benji",
    "bernard": "bernie", "caroline": "carrie caro lina", "catherine": "cathy cat kate katie", "charles": "charlie chuck chas", "charlotte": "charlie lottie lotte char",
    "chidinma": "chidi chichi dinma", "christina": "chris tina chrissy", "christopher": "chris kit topher kris", "concepcion": "concha conchita", "cynthia": "cindy",
    "dalia": "dal", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dimitrios": "dimitri jimmy dimi mitsos", "donald": "don donnie",
    "dorothy": "dot dottie dolly", "douglas": "doug", "edward": "ed eddie ted ned", "edwin": "ed", "ekaterina": "katya kate katia", "eleanor": "ellie nell nora",
    "elizabeth": "liz beth lizzie eliza betty lisa libby betsy bess", "emily": "em emmy", "emmanuel": "manny manu emma", "enrique": "kike", "esteban": "steve este",
    "eugene": "gene", "federico": "fede", "fernando": "nando", "florence": "flo flossie", "frances": "fran frankie fanny", "francis": "frank", "francisco": "paco pancho fran cisco frank kiko",
    "frederick": "fred freddy freddie fritz rick", "gabriel": "gabe", "gabriella": "gabby ella gabi gaby bella", "geoffrey": "geoff jeff", "gerald": "gerry jerry", "giovanni": "gianni nino",
    "giuseppe": "beppe peppe pino", "gregory": "greg", "guadalupe": "lupe lupita", "guillermo": "memo guille", "harold": "harry hal", "haruto": "haru", "henry": "harry hank hal", "herbert": "herb bert",
    "ignacio": "nacho iggy", "ingrid": "inga", "isabella": "bella izzy isa belle", "ivan": "vanya", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn",
    "jeremy": "jerry", "jessica": "jess jessie", "jesus": "chuy", "johannes": "hans jo johan hannes", "john": "jack johnny jon", "jonathan": "jon jonny", "jose": "pepe", "joseph": "joe joey",
    "josephine": "jo josie fina jojo", "joshua": "josh", "judith": "judy", "jurgen": "jorg", "katherine": "kate kathy katie kat kitty kathie kay", "kenneth": "ken kenny", "lawrence": "larry",
    "leonard": "leo len lenny", "leonardo": "leo nardo", "louise": "lou lulu", "lucas": "luke", "lucia": "lucja lucy", "luis": "lucho", "madeleine": "maddie", "manuel": "manolo manny",
    "margaret": "maggie meg peggy greta marge daisy rita", "maria": "masha mia", "martin": "marty", "matthew": "matt", "matthias": "matt matze", "maximilian": "max", "melissa": "mel", "mercedes": "merche",
    "michael": "mike mick mikey misha mickey", "mikhail": "misha", "mohammad": "mo moh hammad", "natalia": "natasha nat", "nathaniel": "nate nat nathan", "nicholas": "nick nicky nico",
    "nikolai": "kolya", "nikolaos": "nick nikos niko nico klaus", "olga": "olya", "oliver": "ollie", "oluwaseun": "seun olu", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy",
    "pavel": "pasha pavlik", "penelope": "penny nell poppy", "peter": "pete", "philip": "phil pip", "priyanka": "pri priya", "quentin": "quinn", "rachel": "rach", "ravindra": "ravi", "raymond": "ray",
    "rebecca": "becky becca", "richard": "rick dick rich richie", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "rosalind": "rosa roz rose lindy", "rosario": "charo", "russell": "russ",
    "salvatore": "toto", "samantha": "sam", "samuel": "sam sammy", "sarah": "sally sadie", "sebastian": "seb basti bastian", "sergei": "seryozha", "stephen": "steve stevie", "stuart": "stu",
    "susan": "sue susie", "tatiana": "tanya", "theodora": "dora theo thea", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "tomas": "tom tomek", "ursula": "uschi ulla",
    "valerie": "val", "veronica": "ronnie", "victor": "vic", "victoria": "vicky tori vic vicki", "vincent": "vince vinnie", "virginia": "ginny", "vladimir": "vova vlad volodya", "walter": "walt wally",
    "wilhelmina": "willa mina billie minnie wilma", "william": "bill will liam billy willy", "winifred": "winnie", "wolfgang": "wolf", "yevgenia": "zhenya genya eugenia", "zacharias": "zach zack zac", "zachary": "zach zack",
}
_SHORT: dict[str, set[str]] = {}
for _g, _names in NICKNAMES.items():
    for _n in _names.split():
        _SHORT.setdefault(_n, set()).add(_g)

#: Words around a name that do not belong to it, particles of family names, words of groups. Fixed values.
TITLES = set("dr prof professor phd msc bsc md ing dipl mr mrs ms sir jr sr ii iii iv esq".split())
PARTICLES = set("de la del der den van von el al dos da di du le las los af av zu zur ten ter bin ibn".split())
GROUP_WORDS = set(
    "collaboration consortium center centre institute laboratory laboratories lab labs group team network initiative project university "
    "department college foundation society association committee school alliance program programme agency council".split()
)
#: Letters that don't come apart into a Latin letter and a mark, and the Cyrillic and Greek letters in Latin ones. Fixed values.
_LATIN = {"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"}
_CYRILLIC = dict(zip("абвгдезийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e z i i k l m n o p r s t u f kh ts ch sh shch . y . e yu ya i i e g".split(), strict=True)) | {"ж": "zh"}
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split(), strict=True))
_LETTERS = {k: "" if v == "." else v for k, v in (_LATIN | _CYRILLIC | _GREEK).items()}
_LETTERS = str.maketrans(_LETTERS | {k.upper(): v.capitalize() for k, v in _LETTERS.items() if len(k.upper()) == 1})
#: Names written without a space, family name first: Han and Hangul.
_UNSPACED = re.compile("[\u4e00-\u9fff]{2,4}|[\uac00-\ud7a3]{2,4}")
_HAN_WORD = re.compile("[\u4e00-\u9fff]+|[\uac00-\ud7a3]+")


def fold(s: str) -> str:
    """Without marks, in Latin letters where the script has them."""
    if s.isascii():
        return s
    text = "".join(c for c in unicodedata.normalize("NFKD", s.translate(_LETTERS)) if not unicodedata.combining(c))
    return unicodedata.normalize("NFKC", text.translate(_LETTERS))


@dataclass(frozen=True)
class Name:
    """A name taken apart. given has letters only; a single letter is an initial."""

    group: bool
    surname: str
    given: str
    middle: str
    particle: str
    alias: str = ""
    words: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()

    @property
    def full(self) -> bool:
        return len(self.given) > 1 or not self.given.isascii()


@lru_cache(maxsize=200_000)
def known_given(w: str) -> frozenset[str]:
    """Given names that a word is, is short for, or is a slip of."""
    if w in NICKNAMES:
        return frozenset([w, *_SHORT.get(w, ())])
    if w in _SHORT:
        return frozenset(_SHORT[w])
    if len(w) >= 4:
        near = [g for g in NICKNAMES if abs(len(g) - len(w)) <= 1 and len(g) >= 4 and edits(g, w, 1) <= 1]
        if not near and len(w) >= 7:
            near = [g for g in NICKNAMES if len(g) >= 7 and edits(g, w, 2) <= 2]
        return frozenset(near)
    return frozenset()


def left_out(w: str) -> list[str]:
    """A word or code, and what is left of it without each of its signs."""
    return list(dict.fromkeys([w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]))


#: Long words of groups by what is left of them without one letter: two words one edit apart share one.
_GROUP_SLIPS: dict[str, list[str]] = {}
for _w in sorted(w for w in GROUP_WORDS if len(w) >= 8):
    for _v in left_out(_w):
        _GROUP_SLIPS.setdefault(_v, []).append(_w)

#: What one slip in such a word leaves whole, at the least: its first three letters or its last three.
_GROUP_ENDS = {w[:3] for w in GROUP_WORDS if len(w) >= 7}, {w[-3:] for w in GROUP_WORDS if len(w) >= 7}

_WORDS = re.compile(r"[^\W\d_]+")
_NO_NAME = re.compile(r"[^\w.'’\-]|[\d_]")


def unspaced(text: str) -> tuple[str, str] | None:
    """(family name, given name) of a name in Han or Hangul: the first sign, or the word of one sign."""
    ws = text.split()
    if len(ws) == 1 and _UNSPACED.fullmatch(ws[0]):
        return ws[0][0], ws[0][1:]
    if len(ws) == 2 and all(map(_HAN_WORD.fullmatch, ws)) and min(map(len, ws)) == 1:
        return (ws[0], ws[1]) if len(ws[0]) == 1 else (ws[1], ws[0])
    return None


def of_group(w: str) -> bool:
    """Whether a word is one of a group's, for long ones also with one slip."""
    if w in GROUP_WORDS:
        return True
    if len(w) < 8 or (w[:3] not in _GROUP_ENDS[0] and w[-3:] not in _GROUP_ENDS[1]):
        return False
    return any(edits(g, w, 1) <= 1 for v in left_out(w) for g in _GROUP_SLIPS.get(v, ()))


@lru_cache(maxsize=200_000)
def readings(raw: str) -> tuple[Name, ...]:
    """The name taken apart, and once more with the family name at the other end where neither a
    comma, nor initials, nor the script tells at which it is."""
    text = fold(unicodedata.normalize("NFC", raw))
    alias = ""
    if m := re.search(r"[\"“”„]([^\"“”„]+)[\"“”„]", text):
        alias = "".join(_WORDS.findall(m[1].lower()))
        text = text[: m.start()] + " " + text[m.end() :]
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
    text = re.sub(r"\d+(\s*,\s*\d+)*", " ", text)
    before, comma, after = text.partition(",")
    tail = [w for w in _WORDS.findall(after)]
    if comma and not [w for w in tail if w.lower() not in TITLES]:
        before, comma, after = f"{before} {after}", "", ""
    if not comma and (family := unspaced(before)):
        return (Name(False, family[0], family[1], "", "", alias),)
    hyphened: dict[str, tuple[str, ...]] = {}

    def pieces(s: str) -> list[str]:
        out = []
        for chunk in s.split():
            bare = _NO_NAME.sub("", chunk)
            if bare.isalpha():
                out.append(bare)
                continue
            if m := re.fullmatch(r"([A-Z])\.?(?:-[A-Z]\.?)+?((?:[A-Z]\.?)*)", bare):  # J.-L. and J.-L.K.
                out += [m[1], *re.findall("[A-Z]", m[2])]
                continue
            for part in bare.replace(".", ". ").split():
                letters = "".join(_WORDS.findall(part))
                if letters:
                    out.append(letters)
                    if "-" in part and all(len(w) >= 3 for w in part.split("-")):
                        hyphened[letters.lower()] = tuple(_WORDS.findall(part.lower()))
        return out

    one, two = pieces(before), pieces(after)
    lower = [w.lower() for w in one + two if w.lower() not in TITLES]
    if len(lower) >= 2 and any(map(of_group, lower)):
        kept = tuple(sorted(w for w in lower if w not in ("the", "of", "and", "for", "on", "behalf")))
        return (Name(True, "", "", "", "", "", kept),)
    one = [w for w in one if w.lower() not in TITLES]
    two = [w for w in two if w.lower() not in TITLES]

    def initials(ws: list[str], shout: bool) -> list[str]:
        """Capitals written together, as in GT, are initials, unless all is in capitals."""
        out: list[str] = []
        for w in ws:
            out += list(w.lower()) if 2 <= len(w) <= 3 and w.isupper() and not shout else [w.lower()]
        return out

    shout = not any(c.islower() for c in before + after)
    one, two = initials(one, shout), initials(two, shout)
    particle = " ".join(w for w in one + two if w in PARTICLES and len(w) > 1)
    one = [w for w in one if w not in PARTICLES]
    two = [w for w in two if w not in PARTICLES]
    turned: tuple[list[str], list[str]] | None = None
    if comma and one and two:
        family, rest = one, two
    else:
        ws = one + two
        if len(ws) < 2:
            return (Name(False, "".join(ws), "", "", particle, alias),)
        long = [w for w in ws if len(w) > 1]
        if len(ws[-1]) == 1 and len(ws[0]) > 1 and not (len(long) >= 2):
            family, rest = [ws[0]], ws[1:]
        elif len(ws[-1]) == 1 and len(long) >= 2:
            family, rest = [long[0]], [long[1], ws[-1]]  # Family Given M
        else:
            family, rest = [ws[-1]], ws[:-1]
        # an initial in the middle says that the given name comes first
        if len(ws[0]) > 1 and len(long) >= 2 and (len(ws[1]) > 1 or len(ws[-1]) == 1):
            if family == [ws[0]]:
                turned = [rest[0]], [ws[0], *rest[1:]]
            else:
                turned = [ws[0]], (ws[1:] if len(ws[1]) > 1 else [ws[-1], *ws[1:-1]])

    def name(family: list[str], rest: list[str]) -> Name:
        given, others = rest[0], rest[1:]
        return Name(False, "".join(family), given, others[0][0] if others else "", particle, alias, (), hyphened.get(given, ()))

    out = [name(family, rest)]
    if turned:
        out.append(name(*turned))
    if len(rest) == 2 and all(len(w) >= 2 for w in rest):  # two given names, or one of two parts
        out.append(replace(out[0], given="".join(rest), middle="", parts=tuple(rest)))
    return tuple(out)


_CODES = {**dict.fromkeys("bp", "1"), **dict.fromkeys("fvw", "2"), **dict.fromkeys("ckgqx", "3"), **dict.fromkeys("szj", "4"), **dict.fromkeys("dt", "5"), "l": "6", "r": "7", **dict.fromkeys("mn", "8")}


@lru_cache(maxsize=200_000)
def phonetic(w: str) -> str:
    """Classes of consonants that sound alike, without vowels, h and y; neighbours of one class
    as one. Letters that have no Latin form stand for themselves."""
    out, last = [], ""
    for c in w:
        k = _CODES.get(c, "" if c.isascii() else c)
        if k and k != last:
            out.append(k)
        last = k
    return "".join(out) or w[:1]


def sounds(code: str) -> list[str]:
    """A code with one sound left out each; sounds that then meet and are alike also as one."""
    if len(code) <= 2:
        return [code]
    out = {code: None}
    for i in range(len(code)):
        less = code[:i] + code[i + 1 :]
        out[less] = None
        if 0 < i < len(code) - 1 and code[i - 1] == code[i + 1]:
            out[code[:i] + code[i + 2 :]] = None
    return list(out)


@lru_cache(maxsize=200_000)
def near_codes(w: str) -> list[str]:
    """A word's code with one sound left out each. Where a code has two sounds at most, one sound
    says too little: there also the letters, with one left out each."""
    code = phonetic(w)
    return sounds(code) + (["w" + v for v in left_out(w)] if len(code) <= 2 else [])


def halves(w: str) -> list[str]:
    """The first and the last half of a word, for its length and for one letter less: words one
    edit apart share one of them, also where two neighbours in the middle are swapped."""
    return [x for n in (len(w), len(w) - 1) for x in (f"{n}<{w[: n // 2]}", f"{n}>{w[len(w) - n + n // 2 + 1 :]}")]


def both(head: str, x: str, y: str, one: str, two: str) -> list[tuple[str, str, str]]:
    """(key, word, word) of two words with their codes, in the order of the codes."""
    rows = [(f"{head}{x}|{y}", one, two)] if x <= y else []
    return rows + ([(f"{head}{y}|{x}", two, one)] if y <= x else [])


def group_keys(words: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(key, word, word or '') of a group. Each key has all its words in it: groups are never more
    than two edits apart, so all words but two are alike and these share a half each, or all but
    a long one, which shares a code."""
    own = [i for i, w in enumerate(words) if w not in GROUP_WORDS]
    if not own:
        return []

    def beside(*at: int) -> str:
        return f"g:{len(words)}:" + " ".join(w for i, w in enumerate(words) if i not in at) + ":"

    rows = []
    for i, j in combinations(range(len(words)), 2):
        for x, y in product(halves(words[i]), halves(words[j])):
            rows += both(beside(i, j), x, y, words[i], words[j])
    for i in own:
        if len(words) == 1 or len(words[i]) >= 10:
            rows += [(beside(i) + v, words[i], "") for v in near_codes(words[i])]
    return rows


def spelt_keys(n: Name) -> list[tuple[str, str, str]]:
    """(key, word, word) of a name without an initial: phonetic codes of the sorted words, with one
    sound of one word left out each, so that one slip leaves a common key. A given name stands
    also for what it is short for. The words are those that the codes stand for, in their order."""
    if n.group:
        return group_keys(n.words)
    if not n.surname:
        return []
    if not n.given:
        return [("m:" + v, n.surname, "") for v in near_codes(n.surname)]
    if not n.full:
        return []
    code = phonetic(n.surname)
    meant = dict.fromkeys(g for g in (n.given, n.alias, *n.parts, *sorted(_SHORT.get(n.given, ()))) if g)
    pairs = [(f, c, g) for g in meant for c in [phonetic(g)] for f in near_codes(n.surname)] + [(code, g, n.given) for g in near_codes(n.given)]
    # a slip in the first letter of a given name, and one in the family name's vowels
    if len(n.given) >= 3:
        pairs.append((code, "r" + phonetic(n.given[1:]), n.given))
    return [row for f, c, g in pairs for row in both("n:", f, c, n.surname, g)]


def heads(n: Name) -> list[str]:
    """The initials that the given name of a person may have."""
    if n.group or not n.surname or not n.given:
        return []
    if not n.full:
        return [n.given]
    return [h for h in dict.fromkeys([n.given[:1], *sorted(g[:1] for g in _SHORT.get(n.given, ())), n.alias[:1], *(w[:1] for w in n.parts)]) if h]


def blocks(n: Name) -> list[str]:
    """Block keys of a name, see ``spelt_keys``. What has an initial in place of a given name has
    the family name instead, with one letter left out each, and the initial."""
    if n.group or n.full:
        return list(dict.fromkeys(k for k, _, _ in spelt_keys(n)))
    return [f"i:{v}:{h}" for h in heads(n) for v in left_out(n.surname)] or [k for k, _, _ in spelt_keys(n)]


def block_rows(raw: str) -> list[tuple[str, tuple[str, str], bool]]:
    """(key, words that it stands for, False), and for each initial that the name may have
    ('', (family name, initial), whether the name has but the initial)."""
    rows: dict[tuple[str, tuple[str, str], bool], None] = {}
    for n in readings(raw):
        for k, one, two in spelt_keys(n):
            rows[k, (one, two), False] = None
        for h in heads(n):
            rows["", (n.surname, h), not n.full] = None
    return list(rows)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(maxsize=400_000)
def slip(a: str, b: str, bound: float = 0.9) -> int:
    """Edits between two words that may be one; 9 if they can't."""
    if a == b:
        return 0
    most = 1 if min(len(a), len(b)) < 10 else 2
    d = edits(a, b, most)
    # scripts that write no vowels, or a sign a syllable, say as much in fewer letters
    least = 3 if a.isascii() and b.isascii() else 6
    return d if d <= most and min(len(a), len(b)) >= least and (jaro_winkler(a, b) >= bound or jaro_winkler(a[::-1], b[::-1]) >= bound) else 9


def same_given(a: Name, b: Name) -> int:
    """Edits between given names, 0 for short forms and initials that fit; 9 if they can't be one."""
    if not a.given and not b.given:
        return 0
    if not a.given or not b.given:
        return 9
    if not a.full or not b.full:
        x, y = (a, b) if not a.full else (b, a)
        heads = {y.given[0], y.alias[:1], *(w[0] for w in y.parts)} if y.full else {y.given[0]}
        return 0 if x.given in heads else 9
    if a.given == b.given:
        return 0
    if a.given in b.parts or b.given in a.parts:
        x, y = (a, b) if a.given in b.parts else (b, a)
        # with the other part beside it, it is read as the name of two parts
        return 9 if x.middle and x.middle in [w[0] for w in y.parts] else 0
    exact = lambda n: known_given(n.given) if n.given in NICKNAMES or n.given in _SHORT else frozenset()
    ka, kb = exact(a), exact(b)
    if a.given in kb or b.given in ka or (a.alias and a.alias == b.given) or (b.alias and b.alias == a.given):
        return 0
    if a.given in NICKNAMES and b.given in NICKNAMES:
        return 9
    return slip(a.given, b.given, 0.85)


def same_name(x: str, y: str) -> bool:
    """Whether two spellings can name the same person or group, by themselves."""
    return fitting(x, y) is not None


def fitting(x: str, y: str) -> tuple[int, int] | None:
    """The first readings of two spellings in which they can name the same person or group."""
    xs, ys = readings(x), readings(y)
    return next(((i, j) for i, j in _ORDER if i < len(xs) and j < len(ys) and _same(xs[i], ys[j])), None)


_ORDER = sorted(((i, j) for i in range(3) for j in range(3)), key=sum)


def _same(a: Name, b: Name) -> bool:
    if a.group or b.group:
        return a.group and b.group and _same_words(a.words, b.words)
    family = slip(a.surname, b.surname)
    if family > 2 or not a.surname:
        return False
    given = same_given(a, b)
    if given > 2 or family + given > (2 if a.full and b.full else 1):
        return False
    if a.middle and b.middle and a.middle != b.middle:
        return False
    return not (a.particle and b.particle and slip(a.particle.replace(" ", ""), b.particle.replace(" ", "")) > 1)


def _same_words(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    if len(a) != len(b):
        return False
    left, total = list(b), 0
    for w in a:
        best = min(left, key=lambda v: slip(w, v))
        d = slip(w, best)
        if d > 2:
            return False
        total += d
        left.remove(best)
    return total <= 2


def signature(n: Name) -> tuple[str, str]:
    """(given name in its usual form or '' for an initial, middle initial or '')."""
    if n.group:
        return " ".join(n.words), ""
    if not n.full:
        return "", n.middle
    known = known_given(n.given)
    if len(known) > 1 and n.given in known:
        known = frozenset([n.given])
    return (next(iter(known)) if len(known) == 1 else n.given), n.middle


def close(a: Column, b: Column) -> Column:
    """Words that ``slip`` may accept: no others ever are, and the JVM sees it first. A swap of
    neighbours is two edits here."""
    one = F.levenshtein(a, b, 2)
    least, apart = F.least(F.length(a), F.length(b)), F.abs(F.length(a) - F.length(b))
    few = one.between(0, 1) | ((one == 2) & (apart == 0)) | ((least >= 10) & (apart <= 2) & (F.levenshtein(a, b, 4) >= 0))
    return (a == b) | ((least >= 3) & (apart <= 2) & few)


def initial_pairs(rows: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: names that may have one initial and have family names one edit
    apart at most, of which one has no more than the initial. Rows: (id, sur, head, short).

    Family names are compared once each, by what is left of them without one letter; those one
    edit apart share that. Only those of names with an initial are looked for among all.
    """
    forms = stage(rows.groupBy("sur", "head").agg(F.max("short").alias("short")), "name-initials")
    less = F.transform(F.sequence(F.lit(1), F.length("sur")), lambda i: F.concat(F.substring("sur", F.lit(1), i - 1), F.substring("sur", i + 1, F.length("sur"))))
    cut = forms.select("sur", "head", "short", F.explode(F.array_distinct(F.concat(F.array("sur"), less))).alias("v")).withColumn("v", F.xxhash64("v", "head"))
    x, y = cut.filter("short").alias("x"), cut.alias("y")
    near = (F.col("x.v") == F.col("y.v")) & (F.col("x.head") == F.col("y.head")) & close(F.col("x.sur"), F.col("y.sur"))
    met = x.join(y, near).select(F.col("x.sur").alias("one"), F.col("y.sur").alias("sur"), F.col("x.head").alias("head")).distinct()
    mine = rows.filter("short").select(F.col("id").alias("u"), F.col("sur").alias("one"), "head").join(met, ["one", "head"])
    found = mine.join(rows.select("id", "sur", "head"), ["sur", "head"]).filter("u <> id")
    return found.select(F.least("u", "id").alias("id_a"), F.greatest("u", "id").alias("id_b")).distinct()


def candidates(raw: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, distinct: the spellings that are worth comparing. Rows: (id).

    Families of unlike letters share a code the more often the more of them there are, so a key
    pairs only spellings whose words are near in letters too: candidates grow as what is alike.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, v, one, two, short) for v in b.column(0).to_pylist() for k, (one, two), short in block_rows(v)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "id", "one", "two", "short"])

    rows = raw.mapInArrow(split, "key string, id string, one string, two string, short boolean")
    # names may share a key's hash by chance, what they are is looked at anyway
    keyed = stage(rows.withColumn("key", F.when(F.col("key") != "", F.xxhash64("key"))), "name-keys")
    members = crowded_members(keyed.filter("key IS NOT NULL").select("key", "id", "one", "two"))
    spelt = bucket_pairs(members, ["one", "two"], lambda x, y: close(x("one"), y("one")) & close(x("two"), y("two")))
    return spelt.unionByName(initial_pairs(keyed.filter("key IS NULL").select("id", F.col("one").alias("sur"), F.col("two").alias("head"), "short"))).distinct()


def link_variants(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, entity): the spellings of one person or group share the entity, its least spelling.

    Spellings are made distinct, blocked by phonetic codes of their sorted words (``blocks``), where
    the join rejects words that are too many edits apart, or where one of two has no more than an
    initial by it and the family name's letters (``initial_pairs``), compared with Jaro-Winkler, edits and the nickname table (``same_name``), and accepted pairs clustered by
    connected components. A spelling that leaves something out, a middle initial or all of the
    given name but its initial, is linked only if what it is linked to agrees: with two different
    middle initials, or given names, to choose from, none is chosen, so it can't join two people.
    A spelling that can be read with the family name at either end is compared in both readings.
    Blocks of any size are paired in parts; the agreement is an aggregate per spelling.

    Nulls are left out; blank spellings and spellings without letters stand alone. Repeated rows
    are one. Ties: the entity is the least spelling by code points. An empty table gives no rows.
    """
    raw = names.select(F.col(name).alias("id")).filter("id IS NOT NULL").distinct()

    pairs = candidates(raw)

    kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at := fitting(x, y):
                    rows.append((x, y, *side(x, at[0]), *side(y, at[1])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 12
            arrays = [pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.string(), *kinds, *kinds], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id_a", "id_b", *(f"{c}_{e}" for e in "ab" for c in SIDE)])

    of = ", ".join(f"given_{e} string, middle_{e} string, full_{e} boolean, open_{e} boolean, turn_{e} int" for e in "ab")
    # few of what was compared are left: rebalanced, so that the many stages over them have few tasks
    links = stage(pairs.mapInArrow(compare, f"id_a string, id_b string, {of}").hint("rebalance"), "name-links")
    kept = agreeing(links)
    groups = connected_components(kept, "u", "v")
    return raw.join(groups, raw.id == groups.node, "left").select(F.col("id").alias(name), F.coalesce("component", "id").alias("entity"))


#: What a link says about each of its ends: see ``side``.
SIDE = ["given", "middle", "full", "open", "turn"]


def side(raw: str, at: int) -> tuple[str, str, bool, bool, int]:
    """(given, middle, whether the given name is in full, whether there are two readings, reading)."""
    names = readings(raw)
    n = names[at]
    return *signature(n), n.full or n.group, len(names) > 1, at


def agreeing(links: DataFrame) -> DataFrame:
    """(u, v): the links that neither end has a choice about."""

    def ends(x: str, y: str) -> DataFrame:
        mine = [F.col(f"{c}_{x}").alias("u" + c[0]) for c in SIDE]
        theirs = [F.col(f"{c}_{y}").alias("v" + c[0]) for c in SIDE]
        return links.select(F.col(f"id_{x}").alias("u"), F.col(f"id_{y}").alias("v"), *mine, *theirs)

    e = ends("a", "b").unionByName(ends("b", "a"))
    # given names a slip or a short form apart are one choice, the least of what a spelling is linked to
    lead = e.filter("uf AND vf").groupBy(F.col("u").alias("w"), F.col("ut").alias("wt")).agg(F.min(F.least("ug", "vg")).alias("lead"))
    e = e.join(lead, (F.col("v") == F.col("w")) & (F.col("vt") == F.col("wt")), "left").withColumn("vg", F.coalesce("lead", "vg")).drop("w", "wt", "lead")
    # a link of equal middles counts before one where a side has none, a usual reading before a turned one
    sure = F.col("um") == F.col("vm")
    given = F.when(F.col("vf"), F.col("vg"))
    middle = F.when(F.col("vm") != "", F.col("vm"))
    usual = F.col("vt") == 0
    told = F.col("uo") & ~F.col("vo")
    choice = e.groupBy("u").agg(
        F.min(F.when(usual, middle)).alias("m0"),
        F.max(F.when(usual, middle)).alias("m1"),
        F.min(middle).alias("n0"),
        F.max(middle).alias("n1"),
        F.min(F.when(sure & usual, given)).alias("s0"),
        F.max(F.when(sure & usual, given)).alias("s1"),
        F.min(F.when(usual, given)).alias("g0"),
        F.max(F.when(usual, given)).alias("g1"),
        F.min(given).alias("h0"),
        F.max(given).alias("h1"),
        F.max(told & (F.col("ut") == 0)).alias("told0"),
        F.max(told & (F.col("ut") == 1)).alias("told1"),
        F.max(F.col("uo") & F.col("vo") & (F.col("ut") != F.col("vt"))).alias("both"),
    )
    at = e.join(choice, "u")
    m0, m1 = F.coalesce("m0", "n0"), F.coalesce("m1", "n1")
    middle_open = (F.col("um") == "") & (F.col("vm") != "") & ((m0 != m1) | (F.col("vm") != m0))
    low = F.coalesce("s0", "g0", "h0")
    high = F.when(F.col("s0").isNotNull(), F.col("s1")).otherwise(F.coalesce("g1", "h1"))
    given_open = ~F.col("uf") & F.col("vf") & ((low != high) | (F.col("vg") != low))
    # a spelling that others read from both ends is read the usual way, or with its turned twin, not at all
    order_open = told & F.col("told0") & F.col("told1") & (F.col("both") | (F.col("ut") == 1))
    blocked = F.coalesce(middle_open, F.lit(False)) | F.coalesce(given_open, F.lit(False)) | F.coalesce(order_open, F.lit(False))
    way = at.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), blocked.cast("int").alias("no"))
    return way.groupBy("u", "v").agg(F.max("no").alias("no")).filter("no = 0").select("u", "v")


def variant_pairs(linked: DataFrame, name: str = "name") -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of spellings of one entity."""
    x = linked.select(F.col(name).alias("name_a"), F.col("entity").alias("e"))
    y = linked.select(F.col(name).alias("name_b"), F.col("entity").alias("f"))
    return x.join(y, (F.col("e") == F.col("f")) & (F.col("name_a") < F.col("name_b"))).select("name_a", "name_b")

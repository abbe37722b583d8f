"""Personal information in free text: bootstrapped contextual extraction.

One pass over the texts lists candidates: spans with the shape of an email address, a telephone or
identity number, a street address or a pair of name words, each with its lexical pattern (the words just before it, how
it is spelled, or what stands on its two sides) and its instance class (digit shape, top-level domain, street type, name
words).  Seeds (addresses in a contact line, international numbers, a short list of identity words, streets with a plain
type word, listed name words) then score the pattern-instance graph in rounds of aggregation and join until nothing
changes: patterns that mostly hold trusted instances become trusted and lend trust to the other instances they hold,
and the other way round; a seed that its pattern and its instance speak against is withdrawn.  What is trusted in the
end is reported, including numbers and names that no list contains.

Null and empty texts have no items.  Texts are read whole.  The graph is aggregated before it is shuffled, so a
pattern that holds a third of all mentions is a handful of rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.workspace import Workspace

# ---- Fixed values: words and formats the rules rest on ----
ID_WORDS = [
    "passport", "reisepass", "ausweis", "personalausweis", "passeport", "pasaporte", "passaporto", "paszport", "dowód", "паспорт", "旅券番号", "パスポート",
    "ssn", "nino", "social security", "insurance number", "security number", "security no", "taxpayer", "tax id", "national id", "ni no", "ni number", "ni no.",  "steuer-id", "steuernummer", "identifikationsnummer",
    "sozialversicherungsnummer", "sécurité sociale", "sécu", "nir", "dni", "nif", "nie", "codice fiscale", "c.f", "carta d'identità", "pesel", "снилс", "инн", "個人番号", "マイナンバー",
]
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "frau", "mme", "mlle", "m", "monsieur", "madame", "sr", "sra", "don", "doña", "sig", "sig.ra", "signora", "dott", "pan", "pani", "г-н", "г-жа"]
FIRM_WORDS = ["gmbh", "ag", "kg", "ltd", "llc", "inc", "plc", "sa", "s.a", "sl", "s.l", "sarl", "srl", "s.r.l", "s.p.a", "spa", "oy", "bv", "ооо", "оао", "& sons", "& co", "sp. z"]
NOT_NAME_WORDS = ["maison", "bodegas", "thanks", "merci", "gracias", "danke", "bäckerei", "hotel", "lane", "street", "road", "avenue", "ave", "st", "rd", "close", "court", "drive", "terrace", "square", "suite", "flat", "unit", "via", "piazza", "plaza", "calle", "rue"]
FILE_ENDINGS = ["png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "pdf", "html", "htm", "php", "mp4", "zip"]
STREET_SEEDS = [
    "street", "avenue", "road", "lane", "close", "court", "drive", "terrace", "square", "crescent", "gardens", "grove", "boulevard", "parkway", "st", "ave", "rd", "ln", "dr", "ct", "sq", "blvd", "straße", "strasse", "str.", "gasse", "allee", "-allee", "-straße", "stra�e",
    "rue", "bd", "boulevard", "avenue", "av.", "impasse", "allée", "all�e", "quai", "calle", "c/", "avda", "avda.", "avenida", "carrer", "pº", "plaza", "pza.", "viale", "v.le", "piazza", "p.za", "p.zza", "corso", "c.so",
    "ul.", "al.", "os.", "ulica", "aleja", "ул.", "пер.", "просп.", "пр-т", "улица", "переулок", "проспект", "шоссе", "区", "市", "町",
]
PARTICLES = "van der|van den|van|von der|von|zu|de la|de los|de|del|della|di|da|dos|du|le|la|ter|ten"
# ---- End of fixed values ----

MOST_NAME_WORDS = 1_000_000
UP = "A-ZÀ-ÖØ-ÞĄĆĘŁŃŚŹŻĂĹĽĎА-ЯЁ"
WORD = rf"[{UP}][\w�’']*[\w�]"
FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 32, 0xA0: 32, 0x202F: 32, 0x2007: 32, 0x2009: 32, 0x2010: 45, 0x2011: 45}

AT = r"(?P<at> ?@ ?| ?[(\[{] ?(?:at|AT|a|ät|arroba|chiocciola|małpa) ?[)\]}] ?| (?:AT|at) |&#64;|%40)"
DOT = r"(?:\.| ?[(\[{] ?(?:dot|DOT|punkt|point|punto|kropka) ?[)\]}] ?| (?:DOT|dot) )"
EMAIL = re.compile(rf"(?<![\w.%+\-])(?P<local>[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{{0,62}}[A-Za-z0-9_])?){AT}(?P<domain>[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+)(?![\w\-])")
AT_HINT = re.compile(r"@|[(\[{] ?(?:at|AT|a|ät|arroba|chiocciola|małpa) ?[)\]}]| AT | at \w[\w\-]*(?:\.| dot | DOT | ?[(\[{])|&#64;|%40")

SEP = r"(?:[ .\-/�]| - | / )"
BODY = rf"\d{{1,3}}(?:{SEP}?\(\d{{1,5}}\))?(?: ?– ?|{SEP})?\d{{1,12}}(?:(?:{SEP}|(?<=\) \d\d) – |(?<=\)\d\d) – |(?<=\) \d) – | – (?=\d{{3,5}} \d))\d{{1,8}}){{0,6}}"
PHONE = re.compile(rf"(?:(?<![\d+])\+{BODY}|(?<![\w.,/+\-])(?:00{BODY}|\(\d{{1,5}}\){SEP}?\d{{2,8}}(?:{SEP}\d{{2,8}}){{0,4}}|\d{{1,5}}(?:{SEP}\d{{2,8}}){{1,5}}|\d{{9,12}}))(?![\w]|[.,/\-]\d)")
SURE_PHONE = re.compile(r"\+.{8,}|\(999\) ?999[ \-]9999|\(0?99999\) 999999|\(0\).{8,}|9\.999\.999\.9999|0099(?: \d+){2,}|0099 9+ 9+(?: 9+)*")
NOT_PHONE = re.compile(r"\d{1,2}([./\-])\d{1,2}\1\d{2,4}|\d{4}([./\-])\d{1,2}\2\d{1,2}|[12]\d{3} ?[\-/] ?[12]\d{3}|\d{1,3}(?:\.\d{1,3}){3}|\d{1,2}\.\d\d ?- ?\d{1,2}\.\d\d|\d{1,4}\.\d+|97[89][ \-].*")
ID = re.compile(r"(?<![\w.,/+\-])(?:[A-Z]{6}[ ]?\d\d[A-Z]\d\d[ ]?[A-Z]\d{3}[A-Z]|[A-Z]{1,2}[ \-]?\d(?:[ \-./]?\d){5,12}(?:[ \-]?[A-Z])?|\d(?:[ \-./]?\d){6,17}(?:[ \-]?[A-Z])?)(?![\w]|[.,/\-]\d)")

HOUSE = r"\d{1,5}(?:[ /]?[a-zA-Z](?![\w]))?"
UNIT = r"(?:(?:Flat|Suite|Unit|Apt\.?|Apartment|Room|Floor|Ste\.?) [\dA-Z]{1,5},? )?"
ADDRESSES = [
    ("en", re.compile(rf"(?<![\w.\-/]){UNIT}{HOUSE} (?:{WORD}(?:-{WORD})? ){{1,2}}(?P<t>(?:Street|Avenue|Road|Lane|Close|Court|Drive|Terrace|Square|Crescent|Place|Way|Gardens|Grove|Hill|Boulevard|Parkway|STREET|AVENUE|ROAD|LANE|CLOSE|COURT|DRIVE|TERRACE)\b|(?:St|Ave|Rd|Ln|Dr|Ct|Blvd|Sq|Pl)\b\.?)")),
    ("de", re.compile(rf"(?<![\w\-]){WORD}(?P<t>str\.|straße|strasse|weg|gasse|platz|allee|ufer|ring|damm|-Allee|-Straße|-Platz|-Weg|-Ring|stra�e) ?{HOUSE}|(?<![\w\-])(?P<u>(?:Am|An der|Im|In der|Zum|Zur|Auf der)) {WORD}(?:-{WORD})? {HOUSE}(?!\d|[./]\d)")),
    ("fr", re.compile(rf"(?<![\w.\-/])\d{{1,4}}(?: ?(?:bis|ter|[a-z])(?!\w))?,? (?P<t>rue|bd|boulevard|avenue|av\.|impasse|place|pl\.|chemin|all(?:é|�)e|quai|route|cours|square|passage|sentier) (?:de la |de l['’]|des |du |de |d['’])?{WORD}(?:-{WORD})?")),
    ("es", re.compile(rf"(?<![\w\-])(?P<t>[Cc]alle|C/|[Cc]\.|[Aa]vda\.?|[Aa]v\.|[Aa]venida|[Pp]laza|[Pp]za\.|[Pp]aseo|[Pp]º|[Cc]amino|[Cc]arrer|[Rr]onda|[Tt]ravesía) ?(?:de la |de los |del |de )?{WORD}(?:-{WORD})?,?(?: n\.?º| nº)? {HOUSE}")),
    ("it", re.compile(rf"(?<![\w\-])(?P<t>Via|via|V\.le|Viale|Piazza|P\.za|P\.zza|Corso|C\.so|Largo|Vicolo|Strada|Piazzale) (?:della |dei |del |di |de )?{WORD}(?:-{WORD})?,? (?:n\. ?)?{HOUSE}")),
    ("pl", re.compile(rf"(?<![\w\-])(?P<t>ul\.|al\.|pl\.|os\.|[Uu]lica|[Aa]leja|[Pp]lac) {WORD}(?:-{WORD})? (?:\d{{1,5}}[a-zA-Z]? m\. ?\d{{1,4}}|{HOUSE})")),
    ("ru", re.compile(rf"(?<![\w\-])(?:(?P<t>ул\.|пер\.|пр\.|просп\.|пр-т|наб\.|пл\.|ш\.|б-р|улица|переулок|проспект|площадь|шоссе) ?{WORD}|{WORD} (?P<u>улица|переулок|проспект|площадь|шоссе|набережная|бульвар|ул\.|пер\.|пр\.|пл\.)),? ?(?:д\. ?|дом )?{HOUSE}")),
    ("ja", re.compile(r"[一-鿿々]{1,4}(?P<t>[市区郡町村])[一-鿿々ぁ-んァ-ヶ]{0,6}?町?\d{1,3}(?:丁目\d{1,3}(?:-\d{1,3})*|番地(?:の?\d+)?|番\d*号?|(?:-\d{1,3})+)(?:番地?\d*号?)?")),
]
STREET = re.compile(
    r"[Ss]t\b|S[Tt][Rr]|A[Vv]|R[Oo]?[Aa]?[Dd]\b|L[Aa]?[Nn]|C[Ll]|C[Oo]u|CO|Ct\b|D[Rr]|T[Ee]|Sq|Pl|Way|G[ar]|Hi|B[lo]|Pa|str\.|stra|weg|gasse|platz|lee|ufer|ring|damm"
    r"|Am |An der|I[mn] |Zu[mr] |Auf|rue|bd|bou|av|imp|pl|ch|quai|route|cours|sq|pass|sent|[Cc]al|C/|[Cc]\.|P[laz]|paseo|Pº|[Cc]a[mr]|[Rr]on|[Tt]rav|[Vv]ia|V\.|Pia|P\.|Corso|Largo|Vic|ul|al\.|os\.|ул|пер|пр|наб|пл|ш\.|шос|бу?л?-?в?р"
)
NUMBER_IN_STREET = re.compile(r"(?<![\w,+]) ?(?<!\d\.)\d{1,5}(?!\d)", re.M)
FOLD_HINT = re.compile("[" + re.escape("".join(map(chr, FOLD))) + "]")
CJK = re.compile("[一-鿿]")
JOIN = rf"(?:,? |(?: [A-ZА-Я]\.)+ | (?:[A-ZА-Я]\. )?(?:{PARTICLES}) )"
NAME_RUN = re.compile(rf"(?<![\w\-@.’'/]){WORD}(?:-{WORD})?(?:{JOIN}{WORD}(?:-{WORD})?)+")
NAME_STEP = re.compile(rf"({WORD}(?:-{WORD})?)(?:({JOIN})|$)")
KANJI_NAME = re.compile(r"(?<![一-鿿々])([一-鿿々]{2})( ?)([一-鿿々]{2})(?![一-鿿々\d])")
HARMED = re.compile("[\x80-ÿĀ-ſƒˆ˜‐-⁄€№™Ѐ-џҐґ]{2,}")
HARM_HINT = re.compile("[ÃÂâÅÄÐÑãåæçèéïĂĹĂâРС][\x80-\xbfĀ-ſƒˆ˜‐-⁄€№™Ђ-џ]")
CLAUSE = re.compile(r"[|–·,;()<>\[\]{}*•✉☎\"“”!?。]|[.:] |\. ?$(?<=[a-zа-я]{7}\.)")


def repair(text: str) -> tuple[str, list[int] | None, list[bool] | None]:
    """(text with doubly decoded letters mended, original offset of each character, whether it was harmed)."""
    if not HARM_HINT.search(text):
        return text, None, None
    out: list[str] = []
    offsets: list[int] = []
    harmed: list[bool] = []
    at = 0

    def plain(a: int, b: int) -> None:
        out.append(text[a:b])
        offsets.extend(range(a, b))
        harmed.extend([False] * (b - a))

    for m in HARMED.finditer(text):
        i = m.start()
        run = m.group()
        for code in ("cp1252", "latin-1", "cp1250", "cp1251"):
            try:
                raw = b"".join(c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode(code) for c in run)
                fixed = raw.decode("utf-8")
            except UnicodeError:
                continue
            plain(at, i)
            k = i
            for c in fixed:
                out.append(c)
                offsets.append(k)
                harmed.append(True)
                k += len(c.encode("utf-8"))
            at = m.end()
            break
    plain(at, len(text))
    offsets.append(len(text))
    return "".join(out), offsets, harmed


def label_before(text: str, line_at: int, pos: int) -> tuple[str, str, str]:
    """(last word, last two words, last four words) before a position in its clause; empty at the start of a line or clause."""
    size = 40
    while True:  # as far back as the clause's last five words, or its start, go
        low = max(line_at, pos - size)
        head = text[low:pos]
        parts = CLAUSE.split(head.rstrip(" :=№#°º\t"))
        clause = parts[-1]
        if low == line_at or len(parts) > 1 or clause.count(" ", 1) > 5:
            break
        size *= 4
    if clause.endswith(".") and clause.count(" ") > 2:
        return "", "", ""  # the end of a sentence, not an abbreviation
    words = clause.rstrip(" .").lower().split()[-4:]
    if not words:
        return ("☎", "☎", "") if head.rstrip().endswith("☎") else ("", "", "")
    if any("�" in w for w in words):
        return "", "", ""
    last = re.sub(r"\d", "9", words[-1])
    return last, re.sub(r"\d", "9", words[-2]) + " " + last if len(words) > 1 else last, " ".join(words)


def sides(t: str, at: int, stop: int, a: int, b: int) -> str:
    """What stands before and after a span in its line: ^ (the line's end), the separator, the label that a colon closes, or w (a word)."""
    i, j = a, b
    while i > at and t[i - 1] in " \t":
        i -= 1
    while j < stop and t[j] in " \t":
        j += 1
    before = "^" if i == at else t[i - 1] if t[i - 1] in ",|–·-;([" else ":" if t[i - 1] in ":=" else "." if t[i - 1] in ".!?" else "w"
    after = "^" if j == stop else t[j] if t[j] in ",|–·-;)]" else "." if t[j] in ".!?" else "w"
    if before == "w":  # the word itself, so that "Visit us at" is a pattern of its own
        k = max(t.rfind(" ", at, i), at - 1) + 1
        before = t[k:i].lower()
    return f"{before} {after}"


def candidates(text: str, given: set[str], family: set[str]) -> Iterator[tuple]:
    """(kind, start, end, pattern, wider pattern, instance, second instance, seed) of every candidate span."""
    mended, offsets, harmed = repair(text)
    t = mended.translate(FOLD) if FOLD_HINT.search(mended) else mended
    broken = "�" in t
    for kind, a, b, *rest in _scan(t, given, family):
        hurt = sum(harmed[a:b]) if harmed is not None else 0
        if broken:
            hurt += t.count("�", a, b)
        # Half of an item's characters, and all of an email's, must have come through unharmed.
        if hurt and (hurt * 2 > b - a or kind == "email"):
            continue
        yield (kind, a, b, *rest) if offsets is None else (kind, offsets[a], offsets[b], *rest)


def _line_of(t: str, pos: int) -> tuple[int, int]:
    stop = t.find("\n", pos)
    return t.rfind("\n", 0, pos) + 1, len(t) if stop < 0 else stop


def _lines(t: str, hits: Iterator[re.Match]) -> Iterator[tuple[int, int]]:
    """Each line with a hit once, in order."""
    stop = -1
    for m in hits:
        if m.end() > stop:
            at, stop = _line_of(t, m.end() - 1)
            yield at, stop


class _Taken:
    """Claimed spans as disjoint intervals in order, for overlap tests by bisection."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def hit(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def add(self, a: int, b: int) -> None:
        i, j = bisect_right(self.ends, a), bisect_left(self.starts, b)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


def _street_lines(t: str) -> Iterator[tuple[int, int]]:
    done = -1
    for m in NUMBER_IN_STREET.finditer(t):
        if m.start() < done:
            continue
        at, stop = _line_of(t, m.start())
        if STREET.search(t, max(at, m.start() - 60), min(stop, m.end() + 100)):
            done = stop
            yield at, stop


def _scan(t: str, given: set[str], family: set[str]) -> Iterator[tuple]:
    taken = _Taken()
    if "@" in t or AT_HINT.search(t):
        for at, stop in _lines(t, AT_HINT.finditer(t)):
            for m in EMAIL.finditer(t, at, stop):
                form = re.sub(r"\s+", "_", m["at"].lower()) + ("d" if re.search(r"dot|DOT|punkt|point|punto|kropka", m["domain"]) else "")
                tld = re.split(r"[^A-Za-z0-9\-]+", m["domain"])[-1].lower()
                if tld.isalpha():
                    taken.add(m.start(), m.end())
                    # Seeds stand in a contact line; a plain one elsewhere is taken for granted until its domain speaks against it.
                    contact = sides(t, at, stop, m.start(), m.end())
                    seed = m["at"].strip() == "@" and contact[0] in "^,|–·:" and contact[-1] in "^,|–·"
                    yield "email", m.start(), m.end(), form, form, tld, "", -1 if tld in FILE_ENDINGS else int(seed)
    japanese = CJK.search(t)
    for at, stop in _street_lines(t):
        for lang, rx in ADDRESSES[:-1]:
            for m in rx.finditer(t, at, stop):
                if not taken.hit(m.start(), m.end()):
                    kind = (m.groupdict().get("t") or m.groupdict().get("u") or "").lower()
                    taken.add(m.start(), m.end())
                    yield "address", m.start(), m.end(), *_street(lang, kind, m, sides(t, at, stop, m.start(), m.end()))
    if japanese:
        for m in ADDRESSES[-1][1].finditer(t):
            taken.add(m.start(), m.end())
            yield "address", m.start(), m.end(), *_street("ja", m["t"], m, sides(t, *_line_of(t, m.start()), m.start(), m.end()))
    for kind, rx in (("phone", PHONE), ("id", ID)):
        for m in rx.finditer(t):
            s = m.group()
            if NOT_PHONE.fullmatch(s) or (kind == "phone" and not 7 <= sum(map(str.isdigit, s)) <= 15) or taken.hit(m.start(), m.end()):
                continue
            l1, l2, tail = label_before(t, t.rfind("\n", 0, m.start()) + 1, m.start())
            shape = re.sub(r"\d", "9", s)
            if kind == "phone":
                seed = bool(SURE_PHONE.fullmatch(shape))
            else:
                seed = any(w in tail if len(w) > 4 or not w.isascii() else w in tail.split() for w in ID_WORDS)
                shape = re.sub("[A-Z]$", "A", shape if s[0].isdigit() or s[:2] in ("ZZ", "QQ") else re.sub("[A-Z]", "A", shape))
            yield kind, m.start(), m.end(), l1, l2, shape, "", int(seed)
    for m in NAME_RUN.finditer(t):
        yield from _names(t, m, taken, given, family)
    if japanese:
        for m in KANJI_NAME.finditer(t):
            a, b = m[1], m[3]
            l1, l2, _ = label_before(t, t.rfind("\n", 0, m.start()) + 1, m.start())
            yield "name", m.start(), m.end(), l1, l2, b, a, int(b in given) + 2 * int(a in family)


def _street(lang: str, kind: str, m: re.Match, around: str) -> tuple[str, str, str, str, int]:
    """(pattern, wider pattern, instance, second instance, seed) of a street: seeds have a plain type word or a unit."""
    year = re.search(r"(?<!\d)(?:19|20)\d\d(?!\d)", m.group()) is not None
    seed = kind.rstrip(".") in STREET_SEEDS or kind in STREET_SEEDS or (lang == "en" and m.group()[0].isalpha())
    return around, around, f"{lang}:{kind}:{'year' if year else 'number'}", "", int(seed)


def _names(t: str, m: re.Match, taken: _Taken, given: set[str], family: set[str]) -> Iterator[tuple]:
    """Adjacent word pairs of a run of capitalised words that may be a person's name."""
    base, run = m.start(), m.group()
    at, stop = _line_of(t, base)
    steps = [(x.start(1), x.end(1), x[1], x[2] or "") for x in NAME_STEP.finditer(run)]
    for (a0, _, a, join), (_, b1, b, _) in zip(steps, steps[1:]):
        g, f = (b, a) if join == ", " else (a, b)
        gs, fs = g.lower().split("-"), f.lower().split("-")
        gk, fk = any(w in given for w in gs), any(w in family for w in fs)
        if join != ", " and not (gk and fk) and any(w in family for w in gs) and any(w in given for w in fs):
            gs, fs, gk, fk = fs, gs, True, True
        start, end = base + a0, base + b1
        l1, l2, _ = label_before(t, at, start)
        if l1 in TITLES:
            l1 = l2 = "title"
        elif l1 == "" and t[max(at, start - 2) : start] == ", ":
            l1 = l2 = ","
        # Pairs of unknown words count at once behind a label that ends in a colon or a title, else (bare) when the graph knows more.
        bare = not (gk or fk) and not (join != ", " and (l1 == "title" or t[at:start].rstrip().endswith((":", "="))))
        rest = t[end : min(stop, end + 10)].lower().lstrip(" ,.")
        if gs[0] in NOT_NAME_WORDS or fs[-1] in NOT_NAME_WORDS or gs[0] in TITLES or fs[0] in TITLES or any(rest.startswith(w) and not rest[len(w) : len(w) + 1].isalpha() for w in FIRM_WORDS):
            continue
        if not taken.hit(start, end):
            yield "name", start, end, l1, l2, "-".join(gs), "-".join(fs), -1 if bare else int(gk) + 2 * int(fk)


@dataclass(frozen=True)
class Trust:
    """Thresholds of the bootstrap."""

    pattern: float = 0.08
    shape: float = 0.75
    domain: float = 0.3
    place: float = 0.3
    doubt: float = 0.02
    support: int = 3
    name_pattern: float = 0.25
    name_share: float = 0.6


MENTIONS = "doc_id bigint, kind string, start_at bigint, end_at bigint, p1 string, p2 string, i1 string, i2 string, seed int"


def mentions(documents: DataFrame, names: DataFrame) -> DataFrame:
    """All candidate spans of documents(doc_id, text); names(word, name_kind) must be a list of bounded size."""
    rows = names.where("word is not null").select("word", "name_kind").limit(MOST_NAME_WORDS + 1).collect()
    if len(rows) > MOST_NAME_WORDS:
        raise ValueError(f"the list of name words must have at most {MOST_NAME_WORDS} rows")
    words = documents.sparkSession.sparkContext.broadcast(({r[0].lower() for r in rows if r[1] == "given"}, {r[0].lower() for r in rows if r[1] == "family"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, family = words.value
        cols = [x.split()[0] for x in MENTIONS.split(", ")]
        for b in batches:
            found = [(d, *c) for d, t in zip(b.column(0).to_pylist(), b.column(1)) if (s := t.as_py()) for c in candidates(s, given, family)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c == "seed" else None) for c, x in zip(cols, zip(*found))], names=cols)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, MENTIONS)


def _shares(edges: DataFrame, key: str, mark: Column, name: str, support: int) -> DataFrame:
    """Share of marked mentions by pattern or instance, of those with enough mentions."""
    by = edges.groupBy("kind", key).agg((F.sum(F.when(mark, F.col("n")).otherwise(0)) / F.sum("n")).alias(name), F.sum("n").alias(f"{name}_n"))
    return by.where(F.col(f"{name}_n") >= support)


def _until_settled(ws: Workspace, state: DataFrame, step: Callable[[DataFrame], DataFrame], flags: list[str]) -> DataFrame:
    """``step`` over and over until the flags no longer change, or are as they were in an earlier round."""
    seen: set[int] = set()
    while True:
        mark = F.sum(F.xxhash64(*[c for c in state.columns if c in KEYS], *flags).bitwiseAND(F.lit((1 << 40) - 1)))
        state, got = ws.keep(step(state), mark=mark)
        if got["mark"] in seen:
            return state
        seen.add(got["mark"])


KEYS = ["kind", "p1", "p2", "i1", "i2"]


def score_numbers(ws: Workspace, spans: DataFrame, trust: Trust) -> DataFrame:
    """(kind, p2, i1) of the pattern-instance edges to be believed, for emails, phones, ids and addresses."""
    edges, _ = ws.keep(spans.where("kind <> 'name'").groupBy("kind", "p1", "p2", "i1").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"), F.min("seed").alias("worst")))
    email, address = F.col("kind") == "email", F.col("kind") == "address"

    def step(state: DataFrame) -> DataFrame:
        wide = _shares(state, "p2", F.col("good"), "w", trust.support)
        narrow = _shares(state, "p1", F.col("good"), "l", trust.support)
        at = state.join(wide, ["kind", "p2"], "left")
        # A street type is as good as the places it stands in, the other instances are as good as their mentions.
        held = F.when(address, (F.col("seed") == 1) | (F.coalesce("w", F.lit(0.0)) >= trust.place)).otherwise(F.col("good"))
        scored = at.join(narrow, ["kind", "p1"], "left").join(_shares(at, "i1", held, "s", trust.support), ["kind", "i1"], "left")
        label = F.when(F.col("p2") != "", F.coalesce("w", F.when(F.length("p1") > 3, F.col("l"))))
        by_shape = F.coalesce(F.col("s"), F.lit(0.0)) >= trust.shape
        # A pattern with enough mentions decides; an unknown or empty one leaves it to the instance.
        decided = F.when(label.isNull(), by_shape).otherwise(label >= trust.pattern)
        # A way of spelling an email says little, the domain under it says all; the plain way needs no witness, only none against it.
        mail = F.coalesce(F.col("s"), F.when(F.col("p1") == "@", 1.0).otherwise(F.coalesce("w", F.lit(0.0)))) >= trust.domain
        # A street without a plain type word needs a place where mostly streets stand, and a number and type that mostly do.
        street = (F.coalesce("w", F.lit(0.0)) >= trust.place) & (F.coalesce("s", F.lit(0.0)) >= trust.place) & F.col("i1").endswith("number")
        doubted = (F.coalesce("w", F.lit(1.0)) < trust.doubt) & (F.coalesce("s", F.lit(1.0)) < trust.doubt)
        good = (F.col("worst") >= 0) & (((F.col("seed") == 1) & ~doubted) | F.when(email, mail).when(address, street).otherwise(decided))
        return scored.select("kind", "p1", "p2", "i1", "n", "seed", "worst", good.alias("good"))

    state = _until_settled(ws, edges.withColumn("good", (F.col("seed") == 1) | (email & (F.col("p1") == "@") & (F.col("worst") >= 0))), step, ["good"])
    return state.where("good").select("kind", "p1", "p2", "i1")


def _name_trust(state: DataFrame, support: int) -> DataFrame:
    """The edges with ps, the share of known names among the mentions of the edge's pattern.

    Bare pairs are held against all mentions of a pattern, the others against those that are not bare.  A lone
    comma is no pattern for a bare pair.
    """
    known, own = F.when(F.col("gk") & F.col("fk"), F.col("n")).otherwise(0), F.when(~F.col("bare"), F.col("n")).otherwise(0)

    def by(key: str, name: str) -> DataFrame:
        sums = state.groupBy("kind", key).agg(F.sum("n").alias("all"), F.sum(known).alias("k_all"), F.sum(own).alias("own"), F.sum(F.when(~F.col("bare"), known).otherwise(0)).alias("k_own"))
        return sums.select("kind", key, F.when(F.col("own") >= support, F.col("k_own") / F.col("own")).alias(name), F.when(F.col("all") >= support, F.col("k_all") / F.col("all")).alias(f"{name}_all"))

    at = state.join(by("p2", "w"), ["kind", "p2"], "left").join(by("p1", "l"), ["kind", "p1"], "left")
    bare = F.when(F.col("p2") != ",", F.coalesce("w_all", "l_all", F.lit(0.0))).otherwise(0.0)
    ps = F.when(F.col("p2") == "", 0.0).when(F.col("bare"), bare).otherwise(F.coalesce("w", "l", F.lit(0.0)))
    return at.withColumn("ps", ps).drop("w", "w_all", "l", "l_all")


def score_names(ws: Workspace, spans: DataFrame, trust: Trust) -> DataFrame:
    """(p2, i1, i2) of the name pairs to be believed, with newly learned given and family words."""
    edges, _ = ws.keep(
        spans.where("kind = 'name'").groupBy("p1", "p2", "i1", "i2").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")).withColumns({"kind": F.lit("name"), "gk": F.col("seed") % 2 == 1, "fk": F.col("seed") >= 2, "bare": F.col("seed") < 0})
    )
    counted = ~F.col("bare") | F.col("gk") | F.col("fk")
    strong = F.col("ps") >= trust.name_pattern

    def step(state: DataFrame) -> DataFrame:
        at = _name_trust(state, trust.support).where(counted)

        def learned(word: str, partner: str) -> DataFrame:
            one = at.select(F.explode(F.split(word, "-")).alias("word"), partner, "n", strong.alias("strong"))
            # A word is learned from known partners, if trusted patterns hold most of its mentions.
            by = one.groupBy("word").agg(F.sum(F.when(F.col(partner), F.col("n")).otherwise(0)).alias("with_known"), F.sum(F.when(F.col("strong"), F.col("n")).otherwise(0)).alias("in_strong"), F.sum("n").alias("n"))
            keep = (F.col("with_known") >= 1) & (F.col("in_strong") >= trust.name_share * F.col("n")) & (F.col("in_strong") >= 1)
            return by.where(keep).select("word")

        given, family = learned("i1", "fk"), learned("i2", "gk")
        tagged = state.withColumns({"a1": F.element_at(F.split("i1", "-"), 1), "a2": F.element_at(F.split("i1", "-"), -1), "b1": F.element_at(F.split("i2", "-"), 1), "b2": F.element_at(F.split("i2", "-"), -1)})
        for col, words, flag in (("a1", given, "gk"), ("a2", given, "gk"), ("b1", family, "fk"), ("b2", family, "fk")):
            tagged = tagged.join(words.select(F.col("word").alias(col), F.lit(True).alias("_hit")), col, "left").withColumn(flag, F.col(flag) | F.coalesce("_hit", F.lit(False))).drop("_hit")
        return tagged.select("kind", "p1", "p2", "i1", "i2", "n", "gk", "fk", "bare")

    state = _until_settled(ws, edges, step, ["gk", "fk"])
    at, ps = _name_trust(state, trust.support), F.col("ps")
    good = (F.col("gk") & F.col("fk")) | ((F.col("gk") | F.col("fk")) & (ps >= trust.name_pattern)) | (ps >= 0.9)
    return at.where(good).select("kind", "p1", "p2", "i1", "i2").distinct()


def find(spark: SparkSession, documents: DataFrame, names: DataFrame, trust: Trust = Trust()) -> DataFrame:
    """(doc_id, kind, start_at, end_at) of every item; overlapping claims are settled by kind, then position."""
    ws = Workspace(spark, "pii")
    spans, _ = ws.keep(mentions(documents, names))
    numbers = score_numbers(ws, spans, trust)
    pairs = score_names(ws, spans, trust)
    kept = spans.where("kind <> 'name'").join(numbers, ["kind", "p1", "p2", "i1"], "left_semi")
    named = spans.where("kind = 'name'").join(pairs, ["kind", "p1", "p2", "i1", "i2"], "left_semi")
    order = F.when(F.col("kind") == "email", 0).when(F.col("kind") == "address", 1).when(F.col("kind") == "id", 2).when(F.col("kind") == "phone", 3).otherwise(4)
    every = kept.unionByName(named).select("doc_id", F.struct(order.alias("o"), F.col("start_at").alias("s"), F.col("end_at").alias("e"), "kind").alias("x"))
    per_doc = every.groupBy("doc_id").agg(F.array_sort(F.collect_set("x")).alias("claims"))
    return per_doc.select("doc_id", F.col("claims.s").alias("s"), F.col("claims.e").alias("e"), F.col("claims.kind").alias("kind")).mapInArrow(_settle_claims, "doc_id bigint, kind string, start_at bigint, end_at bigint")


def _settle_claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The claims of a document in order of rank; one that overlaps a kept one is dropped."""
    for batch in batches:
        out: list[tuple] = []
        for doc, starts, ends, kinds in zip(*(batch.column(i).to_pylist() for i in range(4))):
            taken = _Taken()
            for a, b, kind in zip(starts, ends, kinds):
                if not taken.hit(a, b):
                    taken.add(a, b)
                    out.append((doc, kind, a, b))
        if out:
            cols = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "kind", "start_at", "end_at"])


def redact(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text) with a placeholder such as [EMAIL] in place of each item; null texts stay null."""
    per_doc = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at", "kind"))).alias("items"))
    both = documents.select("doc_id", "text").join(per_doc, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if text is not None and spans:
                    parts, at = [], 0
                    for s in spans:
                        parts += [text[at : s["start_at"]], f"[{s['kind'].upper()}]"]
                        at = s["end_at"]
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return both.mapInArrow(run, "doc_id bigint, text string")

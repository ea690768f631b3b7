"""Problem 7: personal information inside free text.

Method: regular expressions propose spans, checksums (Luhn, mod 97, Verhoeff)
confirm numbers, and the words around a span raise or lower its score. Names are
proposed by what introduces them, or as two capitalised words, which need context.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.lookalike import Rewriter, classes, units
from quillmark.operators.latest import latest_by, latest_wide
from quillmark.session import ship_package

TYPES = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
LEAST = 0.5

_AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+)"
EMAIL = re.compile(rf"(?<![\w.+-])[^\W_][\w.+-]{{0,63}}{_AT}[^\W_][\w-]{{0,62}}(?:{_DOT}[^\W_][\w-]{{0,62}}){{0,3}}{_DOT}[^\W\d_]{{2,24}}(?![\w@-])", re.I)
_SPELLED = "zero|oh|one|two|three|four|five|six|seven|eight|nine|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|un|deux|trois|quatre|cinq|sept|huit|neuf|um|dois|quatro|sete|oito|nove|shunya|ek|do|teen|char|paanch|chhe|saat|aath|nau"
SPELLED = re.compile(rf"(?<!\w)(?:(?:{_SPELLED}|double|triple|plus)[\s,-]+){{6,}}(?:{_SPELLED})(?!\w)", re.I)
NUMBER = re.compile(r"(?<![\w.,/#@-])(?:\+|00)?(?:\(\s?\d{1,5}\s?\)|\d)(?:[ .\-/()]{0,3}\d){6,18}(?![\w]|[.,\-/:]\d|/)")
CODE = re.compile(r"(?<![\w@#./-])(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[A-Z]{2}\d{6,8}[A-Z]?|[A-Z]\d{7,8})(?![\w-])", re.I)
IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}\Z")

# Words near a number that tell what it is.
ID_WORDS = "id|identity|identidad|identité|identidade|ausweis|ausweisnummer|personalausweis|aadhaar|aadhar|pan|passport|pasaporte|passeport|pass|reisepass|passaporte|tax|steuer|steuernummer|cpf|cnpj|dni|nie|nif|nss|ssn|social security|insurance number|card|card number|karte|kartennummer|tarjeta|carte|cartão|credit|debit|iban|account|konto|licence|license|permit|voter|pehchaan|adaiyaala|अधार|आधार|पहचान|அடையாள|ஆதார்"
PHONE_WORDS = "call|phone|ph|mobile|mob|cell|tel|telephone|whatsapp|signal|sms|text me|ring|reach|reach us|my number|mera number|number is|teléfono|telefono|móvil|llám|llama|telefon|handy|ruf|ruf mich|anruf|téléphone|appelez|mon numéro|telefone|celular|ligue|contact|dial|switched on|en number|फोन|फ़ोन|नंबर|கைபேசி|தொலைபேசி|எண்"
NOT_WORDS = "lot|score|tender|views|view|build|version|ticket|tkt|bus|costs?|rupees|rs|price|order|invoice|room|route|train|flight|match|isbn|issn|published|closed on|dated|date|ref|reference|serial|batch|model|pixels?|likes|followers|km|metres|meters|litres|votes|lines?"
_near = lambda words: re.compile(rf"(?<!\w)(?:{words})(?!\w)", re.I)
ID_NEAR, PHONE_NEAR, NOT_NEAR = _near(ID_WORDS), _near(PHONE_WORDS), _near(NOT_WORDS)

_W = r"[^\W\d_][\w'’-]*"
_STREET = r"(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|boulevard|blvd|way|close|court|crescent|terrace|square|cross|nagar|marg|gali|salai|theru|veethi|colony|layout|block|highway|path|row)"
_OWN = rf"(?!(?:lleva|está|estaba|esta|sigue|ya|no|não|estava|continua|ainda|faz|hace|há|que|en|em|y|e|rota|foi|tem|tiene|continua|there|was|is)\\b){_W}"  # a word of a street's name
# Words that no street is called by; a number before one of them counts something.
_NO_STREET = r"(?!(?:the|from|for|of|and|to|at|in|on|was|were|is|calls+|hours*|days|weeks|years|jours|tage|días|dias|people|hai|ki|ka|ke|se|din)\b)"
ADDRESSES = [
    # 12 Mill Road; No. 54/5, Temple Street; Flat 9C, 151 Station Rd; door no 44, 5th temple street; house 9, canal lane
    rf"(?:(?:flat|apt|apartment|door|house|plot|unit|no|h\.?no)\.?\s*)*(?:no\.?\s*)?(?<![\w#@/.-])\d{{1,5}}[a-z]?(?:[/-]\d{{1,4}}[a-z]?)?\s*,?\s+(?:\d{{1,3}}(?:st|nd|rd|th)?\s+|\d{{1,5}}[a-z]?\s+)?(?:{_NO_STREET}{_W}\s+){{1,4}}?{_STREET}\b\.?",
    # calle Mayor 10; avenida X, 5
    rf"\b(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|carrera|rua|av\.|travessa|alameda|praça)[ \t]+(?:{_OWN}[ \t]+){{0,3}}?{_OWN}[ \t]*,?[ \t]*(?:n[.ºo°]*[ \t]*)?\d{{1,5}}[a-z]?\b(?!\s*(?:d[ií]as|semanas|meses|años|anos|horas))",
    # 80 bis, rue Victor Hugo
    rf"(?<![\w#@/.-])\d{{1,5}}\s*(?:bis|ter|quater)?\s*,?\s+(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route)\s+(?:d[eu]s?\s+|de\s+la\s+|l['’])?{_W}",
    # Hauptstraße 9; Berliner Str. 5
    rf"\b{_W}(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring)\s+\d{{1,4}}\s?[a-z]?\b",
    rf"\b(?:{_W}\s)?(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee)\s+\d{{1,4}}\s?[a-z]?\b",
    # 38 Rajiv gali; 12 gandhi salai; 12, காந்தி தெரு; 5 गली
    rf"(?<![\w#@/.-])\d{{1,5}}[a-z]?(?:/\d{{1,4}})?\s*,?\s+(?:{_NO_STREET}[^\W\d_][^\s,!?.]*\s+){{1,3}}?(?:gali|galli|salai|saalai|theru|street|தெரு|சாலை|गली|मार्ग|रोड|सड़क)(?!\w)",
    r"(?:मकान|घर|வீட்டு|கதவு)\s*(?:नंबर|नं|எண்)\.?\s*\d{1,5}",
]
ADDRESS = re.compile("|".join(f"(?:{a})" for a in ADDRESSES), re.I)
HOUSE_WORDS = _near("address|live|lives|living|stay|stays|house|home|flat|door|visit|deliver|delivery|send|vivo|vive|dirección|domicilio|habite|adresse|wohne|wohnt|moro|endereço|ghar|veedu|no|since|at|apartment")
DURATION = re.compile(r"^\d+\s+(?:days?|weeks?|hours?|minutes?|months?|years?|calls?|people|residents|buses|users|units|of|more|times|percent|votes?)\b", re.I)

_CAP = r"[^\W\d_][^\W\d_'’-]{2,24}"
# What is said before or after a name.
NAME_FRAMES = [
    rf"\b(?:my|his|her) (?:full )?name is (?P<n>{_CAP} {_CAP})",
    rf"\bin the name of (?P<n>{_CAP} {_CAP})",
    rf"\b(?:this is) (?P<n>{_CAP} {_CAP}) (?:speaking|here|calling|from)\b",
    rf"\b(?:regards|yours (?:sincerely|truly|faithfully)|sincerely|signed|thanks|cheers|greetings|love)\s*,\s*(?P<n>{_CAP} {_CAP})",
    rf"\b(?:mr|mrs|ms|miss|dr|prof|shri|smt|sri|thiru|herr|frau|señora?|sra?|don|doña|monsieur|madame|mme|senhora?|dona)\b\.? (?P<n>{_CAP}(?: {_CAP})?)",
    rf"\b(?:ask for|spoke to|spoke with|talked to|talk to|meet|met with|call|contact) (?P<n>{_CAP} {_CAP}) (?:at|from|in|of|on|about|for)\b",
    rf"\b(?:i am|i'm) (?P<n>{_CAP} {_CAP})(?:,| from| and)\b",
    rf"\b(?:me llamo|mi nombre es|soy) (?P<n>{_CAP} {_CAP})",
    rf"\b(?:je m['’]appelle|mon nom est|je suis) (?P<n>{_CAP} {_CAP})(?=\s*,|\s+habitant)",
    rf"\b(?:mein name ist|ich heiße|ich heisse) (?P<n>{_CAP} {_CAP})",
    rf"\b(?:meu nome é|me chamo|eu sou) (?P<n>{_CAP} {_CAP})",
    rf"\b(?:mera naam|hamara naam) (?P<n>{_CAP} {_CAP}) hai\b",
    rf"\b(?:en peyar|enga peyar) (?P<n>{_CAP} {_CAP})",
    r"(?:मेरा नाम|मेरे पिता का नाम) (?P<n>[^\s,।.!?]+ [^\s,।.!?]+) (?:है|हैं)",
    r"(?:என் பெயர்|எனது பெயர்) (?P<n>[^\s,.!?]+ [^\s,.!?]+)",
]
NAMES = [re.compile(x, re.I) for x in NAME_FRAMES]
# Words that follow such a frame without being a name.
NOT_NAMES = set(
    "the a an this that these those and or not all our your their his her its my we you they it is are was were be been to of in on at for from with by as one some no any who what when where why how very much more most just only also here there now then today tomorrow "
    "ward office mayor council councillor minister officer clerk manager driver drivers police team group people residents volunteers parents students nurses tenants shopkeepers commuters pensioners workers street vendors night shift "
    "los las el la un una les le des du de der die das ein eine os as o "
    "para por con sin que qui quoi pas bien très sehr nicht".split()
)
# Who a name may follow, what is handed to people, and what people do; by language.
KIN = _near("friend|uncle|aunt|auntie|brother|sister|neighbour|neighbor|cousin|teacher|nurse|mother|father|son|daughter|wife|husband|colleague|landlord|tenant|classmate|amigo|amiga|vecino|vecina|hermano|hermana|tío|tía|primo|prima|ami|amie|voisin|voisine|frère|sœur|oncle|tante|freund|freundin|nachbar|nachbarin|bruder|schwester|onkel|vizinho|vizinha|irmão|irmã|tio|tia|dost|bhai|behen|chacha|anna|akka|thambi")
HANDED = _near("(?:give|gave|hand|handed|pay|paid|send|sent|deliver|delivered|return|returned|owe|owed|belongs?|lent|write|wrote)(?: (?!to )[a-zà-ÿ]+){0,3} to|(?:accompanied|signed|treated|interviewed|married) (?:by|to)")
# Second words of places and bodies that are written like names.
BODIES = set("park road street lane avenue school college university hospital clinic station temple church mosque market mall square bridge lake river beach hill hills hall court council office board bank club party department ministry police government committee minister union news times post line metro city town village ward nadu pradesh district county state states airport hotel museum library association foundation trust limited ltd company festival league cup".split())
DOES = re.compile(r"\s+(?:will (?:collect|come|call|pay|bring|pick|be there|meet|send)|said|says|told|saw|called|phoned|lives|lived|works|signed|wrote|paid|married|died|was born|is my|was my|from (?:flat|house|room|number))(?!\w)", re.I)
PAIR = re.compile(r"(?<![\w#@.'’-])([^\W\d_a-z][^\W\d_A-Z'’-]{2,24}) ([^\W\d_a-z][^\W\d_A-Z'’-]{2,24})(?![\w'’-])")
PLACE_END = re.compile(r"(?:nagar|patti|pettai|malai|gram|kulam|thurai|vadi|puram|kadu|ville|burg|town|city|stadt)\Z", re.I)
MASKED = re.compile(r"\[(?:EMAIL|PHONE|ID|ADDRESS|NAME)\]|@[\w.]+(?=\s|$)|https?://\S+|www\.\S+")


def luhn(digits: str) -> bool:
    """Luhn checksum of a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


# Multiplication of the dihedral group of order ten and its permutation.
_D = [[(i + j) % 5 if i < 5 and j < 5 else 5 + (i + j) % 5 if i < 5 else 5 + (i - j) % 5 if j < 5 else (i - j) % 5 for j in range(10)] for i in range(10)]
_P = [list(range(10)), [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]]
for _k in range(2, 8):
    _P.append([_P[_k - 1][_P[1][i]] for i in range(10)])


def verhoeff(digits: str) -> bool:
    """Verhoeff checksum of a twelve-digit identity number."""
    c = 0
    for i, x in enumerate(reversed(digits)):
        c = _D[c][_P[i % 8][int(x)]]
    return c == 0


def mod97(code: str) -> bool:
    """ISO 7064 mod 97-10, as in bank account numbers."""
    s = code.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _plain(text: str) -> tuple[str, list[int]]:
    """The text with look-alikes made equal, and for each of its characters the place in ``text``.

    Characters that vanish or grow are followed, so spans map back to the original.
    """
    if text.isascii() or not _CHANGES.search(text):
        return text, []
    out, back, at = [], [], 0
    for u in units(text):
        v = _PLAIN.get(u)
        if v is None:
            v = _rewriter()(u)
            v = unicodedata.normalize("NFKC", v) if not v.isascii() else v
            v = "".join(str(unicodedata.digit(c)) if c.isdigit() and not c.isascii() and unicodedata.digit(c, None) is not None else c for c in v)
            if len(_PLAIN) < 100_000:  # a memory, not a limit: a unit beyond it is rewritten again
                _PLAIN[u] = v
        out.append(v)
        back.extend([at] * len(v))
        at += len(u)
    back.append(len(text))
    return "".join(out), back


_PLAIN: dict[str, str] = {}
_REWRITER: list[Rewriter] = []


def _rewriter() -> Rewriter:
    """A rewriter to ASCII where there is a look-alike; made once for each worker."""
    if not _REWRITER:
        ascii_first = {chr(i): 1000 for i in range(32, 127)}
        wide = {chr(i): 1 for i in range(0xFF01, 0xFF5F)}
        _REWRITER.append(Rewriter(classes(ascii_first | wide)))
    return _REWRITER[0]


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """Personal data in a text: (start, end, type, score), not overlapping, in order."""
    plain, back = _plain(text)
    taken: list[tuple[int, int]] = [m.span() for m in MASKED.finditer(plain)]
    found: list[tuple[int, int, str, float]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y in taken)

    def add(a: int, b: int, kind: str, score: float) -> None:
        if score >= LEAST and free(a, b):
            taken.append((a, b))
            found.append((a, b, kind, min(1.0, score)))

    low = plain.lower()
    hints, spelled = _hints(low)
    if "@" in plain or "at" in low and ("dot" in low or "(at" in low or "[at" in low or "( at" in low or _AT_HOST.search(low)):
        for m in EMAIL.finditer(plain):
            clear = "@" in m.group() or re.search(r"[(\[{]", m.group())
            local = re.split(_AT, m.group(), maxsplit=1, flags=re.I)[0]
            loud = " AT " in m.group() or re.search(r"\sdot\s", m.group(), re.I)  # said out, not written
            explicit = clear or re.search(r"[._+\d-]", local) or loud and len(local) > 5
            taken[:] = [t for t in taken if not (m.start() < t[0] < m.end() and plain[t[0]] == "@")]
            add(m.start(), m.end(), "EMAIL", 0.9 if explicit else 0.3)
    digit = _DIGIT.search(plain) is not None
    if digit and "address" in hints:
        for m in ADDRESS.finditer(plain):
            if DURATION.match(m.group()):
                continue
            before = plain[max(0, m.start() - 25) : m.start()]
            score = 0.55 + 0.3 * bool(HOUSE_WORDS.search(before)) - 0.3 * bool(_COUNTING.search(before + m.group()))
            add(m.start(), m.end(), "ADDRESS", score)
    if digit:
        for m in CODE.finditer(plain):
            code = m.group().replace(" ", "").upper()
            good = mod97(code) if IBAN.match(code) and len(code) >= 15 else False
            add(m.start(), m.end(), "ID", 0.2 + 0.5 * good + 0.4 * bool(re.fullmatch(r"[A-Z]{5}\d{4}[A-Z]", code)) + _context(plain, m, ID_NEAR) - _context(plain, m, NOT_NEAR, 16, 8))
        for m in NUMBER.finditer(plain):
            kind, score = _number(plain, m)
            add(m.start(), m.end(), kind, score)
    for m in SPELLED.finditer(plain) if spelled > 6 else ():
        add(m.start(), m.end(), "PHONE", 0.5 + _context(plain, m, PHONE_NEAR))
    for k, frame in enumerate(NAMES):
        for m in frame.finditer(plain) if k in hints else ():
            name = m.group("n")
            parts = re.split(r"[ ]", name)
            usual = [p for p in parts if p.lower() in NOT_NAMES or PLACE_END.search(p)]
            # A name may be written small; the frame carries it then.
            if not usual and free(*m.span("n")):
                add(*m.span("n"), "NAME", 0.8)
    for m in PAIR.finditer(plain):
        add(*m.span(), "NAME", _name(plain, m))
    if back:
        found = [(back[a], back[b], k, s) for a, b, k, s in found]
    return sorted(found)


_AT_HOST = re.compile(r"\sat\s[^\W_][\w-]*\.[^\W\d_]{2,}")
_DIGIT = re.compile(r"\d")
# Any code point that is rewritten or is a digit or form of another script.
_CHANGES = re.compile("[^\x00-\x7f\u00a1-\u00ac\u00ae-\u017f\u0900-\u0965\u0970-\u0be5\u2600-\u27bf\ufe0f\U0001f000-\U0001faff]")
# Substrings, in lower case, without which no frame of that number (or no address) can match.
_HINTS = {
    "address": ["street", " st", "road", " rd", "lane", " ln", "avenue", " ave", "drive", " dr", "boulevard", "blvd", " way", "close", "court", "crescent", "terrace", "square", "cross", "nagar", "marg", "gali", "galli", "salai", "saalai", "theru", "veethi", "colony", "layout", "block", "highway", "path", " row", "calle", "c/", "avenida", "avda", "plaza", "paseo", "camino", "carrera", "rua ", "av.", "travessa", "alameda", "praça", "rue ", "place", "chemin", "impasse", "allée", "quai", "route", "straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ufer", "damm", "ring ", "தெரு", "சாலை", "गली", "मार्ग", "रोड", "सड़क", "मकान", "घर", "வீட்டு", "கதவு"],
    0: ["name is"],
    1: ["in the name of"],
    2: ["this is "],
    3: ["regards", "yours", "sincerely", "signed", "thanks", "cheers", "greetings", "love"],
    4: ["mr", "mrs", "ms", "miss", "dr", "prof", "shri", "smt", "sri", "thiru", "herr", "frau", "señor", "sr", "don", "doña", "monsieur", "madame", "mme", "senhor", "dona"],
    5: ["ask for", "spoke ", "talked to", "talk to", "meet ", "met with", "call ", "contact "],
    6: ["i am ", "i'm "],
    7: ["me llamo", "mi nombre", "soy "],
    8: ["appelle", "mon nom", "je suis"],
    9: ["mein name", "ich heiße", "ich heisse"],
    10: ["meu nome", "me chamo", "eu sou"],
    11: [" naam"],
    12: [" peyar"],
    13: ["मेरा नाम", "का नाम"],
    14: ["பெயர்"],
}
_AUTOMATON: list = []


def _hints(low: str) -> tuple[set, int]:
    """Which frames can match at all, and how many number words there are, by one pass of an automaton."""
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        owners: dict[str, list] = {}
        for kind, subs in _HINTS.items():
            for x in subs:
                owners.setdefault(x, []).append(kind)
        for x in _SPELLED.split("|"):
            owners.setdefault(x, []).append("number")
        for x, kinds in owners.items():
            a.add_word(x, kinds)
        a.make_automaton()
        _AUTOMATON.append(a)
    hints: set = set()
    numbers = 0
    for _, kinds in _AUTOMATON[0].iter(low):
        for k in kinds:
            if k == "number":
                numbers += 1
            else:
                hints.add(k)
    return hints, numbers
_COUNTING = re.compile(r"(?<!\w)(?:waited|bus|route|error|line|platform|gate|lot|ticket|build|score|costs|rupees|views)(?!\w)", re.I)


def _context(plain: str, m: re.Match, words: re.Pattern, left: int = 32, right: int = 22) -> float:
    """0.4 if one of ``words`` stands just before the span, 0.25 if just after, else 0."""
    start = max(plain.rfind(c, 0, m.start()) for c in ".!?\n") if m.start() else -1
    if words.search(plain, max(0, m.start() - left, start), m.start()):
        return 0.4
    line = plain.find("\n", m.end())
    stop = m.end() + right if line < 0 else min(line, m.end() + right)
    near = words.search(plain, m.end(), stop + 12)  # a word must begin within reach
    return 0.25 if near and near.start() < stop else 0.0


_WORDS = re.compile(r"[^\W\d_]+")


def _name(plain: str, m: re.Match) -> float:
    """Score of two capitalised words as a person's name, by who stands before them and what they do."""
    if any(not p[0].isupper() or p.lower() in NOT_NAMES or PLACE_END.search(p) for p in m.groups()):
        return 0.0
    if m.group(2).lower() in BODIES:
        return 0.0
    words = _WORDS.findall(plain)
    if sum(w[0].isupper() for w in words) > 0.3 * len(words) + 1:  # a text of capitals says nothing
        return 0.0
    start = max((plain.rfind(c, 0, m.start()) for c in ".!?\n"), default=-1) + 1
    before = plain[max(start, m.start() - 40) : m.start()]
    near = before.rstrip().rsplit(maxsplit=1)[-1:] or [""]
    kin = KIN.fullmatch(near[0].strip(",")) is not None
    handed = any(h.end() >= len(before) - 1 for h in HANDED.finditer(before))
    does = DOES.match(plain, m.end()) is not None
    return 0.2 + 0.4 * kin + 0.4 * handed + 0.35 * does


def _number(plain: str, m: re.Match) -> tuple[str, float]:
    """Type and score of a run of digits."""
    raw = m.group()
    digits = re.sub(r"\D", "", raw)
    n = len(digits)
    is_id, is_phone, is_not = _context(plain, m, ID_NEAR), _context(plain, m, PHONE_NEAR), _context(plain, m, NOT_NEAR, 16, 8)
    if re.fullmatch(r"(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})", raw) or re.fullmatch(r"\d{1,3}(?:[., ]\d{3})+", raw) and "," in raw:
        return "ID", 0.0
    social = bool(re.fullmatch(r"\d{3}[- .]\d{2}[- .]\d{4}", raw))
    grouped = bool(re.fullmatch(r"\d{4}[ .-]\d{4}[ .-]\d{4}(?:[ .-]\d{4})?", raw))
    check = n == 12 and verhoeff(digits) or 13 <= n <= 19 and luhn(digits)
    ident = 0.1 + 0.35 * check + 0.3 * social + 0.3 * grouped + is_id + 0.2 * (n == 12 and is_id > 0)
    phone = 0.1 + is_phone
    if raw[0] == "+" or raw[:2] == "00" and n > 10 and not is_id and not grouped:
        phone += 0.5
    elif re.match(r"\(\s?\d{2,5}\s?\)", raw) or digits[0] == "0" and 9 <= n <= 11:
        phone += 0.35
    elif 10 == n:
        phone += 0.3
    elif 9 <= n <= 13:
        phone += 0.1
    if n < 7 or n > 15:
        phone = 0.0
    if n < 9:
        ident = min(ident, 0.3)
    if social or n == 12 and is_id and raw[0] != "+":
        phone = min(phone, 0.3) if social else 0.0
    if raw[0] == "+":
        ident = min(ident, 0.3)
    kind, score = ("ID", ident) if ident > phone else ("PHONE", phone)
    return kind, score - 1.0 * is_not


def replaced(text: str, found: list[tuple[int, int, str, float]]) -> str:
    """The text with typed placeholders in place of the spans."""
    out, at = [], 0
    for a, b, kind, _ in found:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def personal_data(df: DataFrame, key: str, column: str, time: str | None = None) -> DataFrame:
    """Finds by type and the redacted text: ``key``, ``redacted_text``, ``finds`` array<struct<start, end, type, score>>.

    Where ``time`` is given the latest row of a key counts. Null texts give a null
    text and no finds; texts without finds come out unchanged. Offsets are code
    points of the original. Whole texts are read; extra columns are not. Only texts
    of keys that occur more than once are shuffled.
    """
    ship_package(df.sparkSession)
    kind = dict(df.dtypes)[key]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [spans(t) if t else [] for t in texts]
            out = [t if t is None else replaced(t, f) if f else t for t, f in zip(texts, found)]
            rows = [[{"start": x, "end": y, "type": k, "score": s} for x, y, k, s in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(rows, pa.list_(span))], names=[key, "redacted_text", "finds"])

    base = df.select(key, column) if time is None else latest_wide(df.select(key, column, time), [key], time, [F.xxhash64(column)]).select(key, column)
    return base.mapInArrow(run, f"`{key}` {kind}, redacted_text string, finds array<struct<start: int, end: int, type: string, score: double>>")


def found_types(df: DataFrame, key: str, column: str, time: str) -> DataFrame:
    """Distinct (key, pii_type) of the latest row of each key.

    Only digests of the finds travel: every row is searched where it is read, and
    the types found, not the text, take part in picking the latest row.
    """
    ship_package(df.sparkSession)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [sorted({k for _, _, k, _ in spans(t)}) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(types, pa.list_(pa.string()))], names=["k", "at", "tie", "types"])

    rows = df.select(F.col(key), F.col(column), F.col(time), F.xxhash64(column)).mapInArrow(run, f"k {kinds[key]}, at {kinds[time]}, tie bigint, types array<string>")
    return latest_by(rows, ["k"], "at", [F.col("tie")]).select(F.col("k").alias(key), F.explode("types").alias("pii_type"))

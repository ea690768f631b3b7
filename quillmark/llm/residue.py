"""Problem 10: template residue, filler and error pages.

Method: character n-gram models of filler, of error notices and of natural prose
give each piece of a text a log-likelihood ratio. Windows of high ratio localise
residue; a document is excluded by the share of its text that they cover. Prose
and fillers are learned from the corpus and from the seed texts below. Unfilled
placeholders have no language of their own, so their syntax is matched by
patterns, which is a departure from the method for that one kind.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import ship_package

# Seed texts of filler.
FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
vestibulum tincidunt mauris suspendisse egestas turpis fermentum placerat praesent velit nullam aliquam quisque consequat
pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo
nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt neque porro quisquam est qui dolorem ipsum quia dolor sit amet
at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident similique
curabitur pretium tincidunt lacus nulla gravida orci a odio nullam varius turpis et commodo pharetra est eros bibendum elit nec luctus magna felis sollicitudin mauris integer in mauris eu nibh euismod gravida
duis ac tellus et risus vulputate vehicula donec lobortis risus a elit etiam tempor ut ullamcorper ligula eu tempor congue eros est euismod turpis id tincidunt sapien risus a quam maecenas fermentum consequat mi
donec fermentum pellentesque malesuada nulla a mi duis sapien sem aliquet nec commodo eget consequat quis neque aliquam faucibus elit ut dictum aliquet felis nisl adipiscing sapien sed malesuada diam lacus eget erat
cras mollis scelerisque nunc nullam arcu aliquam consequat curabitur augue lorem dapibus quis laoreet et pretium ac nisi aenean magna nisl mollis quis molestie eu feugiat in orci in hac habitasse platea dictumst
fusce convallis mauris imperdiet gravida bibendum nisl turpis suscipit mauris sed placerat ipsum urna sed risus in convallis tellus a mauris curabitur non elit ut libero tristique sodales mauris a lacus
phasellus ultrices nulla quis nibh quisque a lectus donec consectetuer ligula vulputate sem tristique cursus nam nulla quam gravida non commodo a sodales sit amet nisi
sample text sample text sample text
this is a sample paragraph
your headline here
your title here
your text here
insert your text here
click here to edit this text block
double click to edit this text
add your description here
this is a dummy paragraph and only shows how the layout looks
this is dummy text
this is placeholder text for the layout
placeholder text
body text body text body text
caption one caption two caption three
heading one heading two
coming soon content for this section
content goes here
text goes here
xxxx xxxx xxxx
x x x x x x
test test test test
asdf asdf asdf qwerty
foo bar baz foo bar
tbd tbd tbd copy to come
to be written
headline goes here subtitle goes here
your subtitle here
caption caption caption body text body text
placeholder paragraph for this section
lorem text for the preview
replace this text with your own
write something here
type your message here
write your post here
title of the article goes here
description goes here
example text example text
demo content for the theme
nothing to see here yet
platzhaltertext für diesen abschnitt
beispieltext bitte ersetzen
hier kommt der text hin
überschrift hier einfügen
texte provisoire pour cette section
texte de remplissage
titre de la page ici
texto provisional para esta sección
texto de relleno
título de la página aquí
texto provisório para esta seção
título da página aqui
यहाँ अपना पाठ लिखें नमूना पाठ
உங்கள் உரையை இங்கே எழுதவும்
aquí va el texto de ejemplo de esta página
texto de ejemplo
escriba su texto aquí
texte d'exemple à remplacer
insérez votre texte ici
votre texte ici
hier steht ein beispieltext
blindtext für das layout
ihr text hier
aqui vai o texto de exemplo
texto de exemplo
insira seu texto aqui
यहाँ नमूना पाठ लिखें
இங்கே மாதிரி உரை
"""
# Seed texts of error pages and of notices that ask for scripts or cookies.
NOTICES = """
404 not found the page you asked for could not be found
page not found
the requested url was not found on this server
sorry nothing lives at this address any more
this page does not exist
oops that page can t be found
it looks like nothing was found at this location
nothing was found here try a search
we can t find the page you are looking for
the page you are looking for has moved or no longer exists
500 internal server error
internal error request
error 503 the service is not available at the moment
service unavailable try again later
502 bad gateway
504 gateway timeout
the connection timed out before the server answered
the server took too long to respond
403 forbidden access denied
access to this item was refused
you do not have permission to view this page
too many requests from your address wait seconds
rate limit exceeded
this video is no longer available
this content is not available
this item was removed
session expired sign in again to see this thread
your session has expired please log in
we hit a snag and this thread did not load
something went wrong and the page did not load
oops something went wrong
an unexpected error occurred
null pointer exception at line
uncaught typeerror undefined is not a function
stack trace traceback most recent call last
null pointer at post render line
traceback worker stopped keyerror in render step
fatal error segmentation fault core dumped
internal error try again later request
prove that you are not a robot to go on
please complete the captcha to continue
verify that you are human
bad gateway node did not reply
database query failed near line
database connection error
could not connect to the database
the upstream server did not reply in time
checking your connection before you go on ray
this site cannot be reached
this item is not available in your region
the link has expired
you have been blocked
please sign in to view this content
log in to continue
the server is down for maintenance
we will be back soon
scheduled maintenance please come back later
unable to load the comments
failed to load resource
request could not be processed
invalid request token
unhandled exception in worker thread
memory limit exceeded
warning undefined index in line
syntax error unexpected token
reference request id trace id
retry refresh the page
contact support
your cookies are switched off
this site uses cookies please accept them to go on
turn on cookies in your browser
el servidor no responde
vuelva a intentarlo más tarde
active las cookies para continuar
habilite javascript en su navegador
el contenido ya no está disponible
ha ocurrido un error
le serveur ne répond pas
le contenu n'est plus disponible
une erreur est survenue
activez les cookies pour continuer
der server antwortet nicht
der inhalt ist nicht mehr verfügbar
ein fehler ist aufgetreten
bitte cookies aktivieren um fortzufahren
o servidor não responde
o conteúdo não está mais disponível
ocorreu um erro
ative os cookies para continuar
please turn on scripts in your browser to read this thread
please enable javascript to continue
this page needs javascript enable it and load the page again
you need to enable js to run this app
your browser has scripts switched off so the comments cannot be shown
javascript is disabled in your browser
cookies and scripts must be allowed to open this post
please enable cookies and reload the page
please accept cookies to continue
checking your browser before accessing
your browser is not supported
reload
go back to the start page
home help sign in
thank you for your patience
if this keeps happening tell the site owner
if the problem persists contact the site administrator
try again later
please try again
ref code
página no encontrada el enlace ya no existe
error del servidor inténtelo más tarde
servicio no disponible código
active el código javascript para ver los comentarios
active javascript en su navegador
acceso denegado
página não encontrada
serviço indisponível tente novamente mais tarde
ative o javascript para ver esta página
acesso negado
page introuvable erreur
erreur interne du serveur
service indisponible réessayez plus tard
veuillez activer les scripts pour lire la page
veuillez activer javascript dans votre navigateur
accès refusé
seite nicht gefunden fehler
interner serverfehler
dienst nicht verfügbar bitte später erneut versuchen
bitte aktivieren sie javascript um diese seite zu sehen
bitte skripte im browser einschalten
zugriff verweigert
पृष्ठ नहीं मिला त्रुटि
सेवा उपलब्ध नहीं है
कृपया जावास्क्रिप्ट चालू करें
பக்கம் கிடைக்கவில்லை பிழை
சேவை கிடைக்கவில்லை
ஜாவாஸ்கிரிப்டை இயக்கவும்
"""
_NAME = r"[A-Za-z_][\w.\- |:/]{0,60}"
# Syntax of substitutions that were left open or broke.
PLACEHOLDERS = [
    r"\{\{.{0,80}?\}\}",  # {{ name }}
    r"\{%.{0,80}?%\}",  # {% block %}
    r"<%.{0,80}?%>",  # <%= name %>
    r"[#$@]\{\s*" + _NAME + r"\}",  # ${name}
    r"\{(?:\d{1,2}|[A-Za-z_]\w*(?:[._]\w+)*)\}",  # {name} {0}
    r"%\([A-Za-z_][\w.]*\)[sdfr]",  # %(name)s
    r"(?<![\w%])%[A-Za-z]+(?:[._][A-Za-z]+)*%(?![\w%])",  # %name%
    r"<<\s*" + _NAME + r">>",  # <<name>>
    r"\[\[\s*" + _NAME + r"\]\]",  # [[name]]
    r"(?<!\w)__[A-Za-z][A-Za-z_]*?__(?!\w)",  # __NAME__
    r"@@[A-Za-z_][\w.]*@@",  # @@name@@
    r"(?i:[\[<](?:insert|your|add|enter|type|choose|put|fill in|replace)\b[\w '-]{0,40}[\]>])",  # [insert name here] <your name>
    r"(?i:[\[<](?:\w+ ){0,3}here[\]>])",
    r"(?i:[\[<][\w ]{0,30}\b(?:to be (?:added|announced|confirmed|written|filled in|done)|to come|tbd|tba|todo)[\]>])",  # [date to be added]
    r"(?i:\[object object\])",
    r"\b(?:nan|NaN)\s*/\s*(?:null|undefined|NaN)\b",
    r"(?<=[:=] )(?:undefined|NaN|null)(?=[\s,.;!?/]|$)",  # ward: undefined
    r"(?<!\w)(?:undefined|NaN|null)(?=, | *$)",
    r"(?i:\b(?:hello|hi|dear|by|in|for|at|from|on|to|of|regards,?|and|ward|date|name)[ ,:]+)(?:undefined|NaN|null)(?=[\s,.;!?/]|$)",
    r"(?<!\w)(?:undefined|null|NaN) (?:wrote|said|posted|starts|is|was|has|reported)\b",
]
_UNSET = re.compile("undefined|null|nan", re.I)
_BY_SIGN, _BY_WORD = (re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS if bool(_UNSET.search(p)) is unset)) for unset in (False, True))
PIECE_END = re.compile(r"[.!?\n।:;|]+")
_TOKEN = re.compile(r"[^\W_]+")
def placeholder(text: str) -> bool:
    """Whether a substitution was left open; the patterns are only tried where a sign or word of theirs occurs."""
    signs = any(x in text for x in "{<[%") or "__" in text or "@@" in text
    unset = any(x in text for x in ("undefined", "null", "NaN")) or "/" in text and "nan" in text
    return signs and _BY_SIGN.search(text) is not None or unset and _BY_WORD.search(text) is not None


_NUMBERS = re.compile(r"\d+")
_SPACE = re.compile(r"[\W_]+")
N = 4
FULL = 60


def normal(text: str) -> str:
    """Lower-case words with single spaces, numbers as one sign."""
    return " " + _SPACE.sub(" ", _NUMBERS.sub("0", text.lower())).strip() + " "


class NgramModel:
    """Interpolated character n-gram model with Witten-Bell smoothing."""

    def __init__(self, counts: Counter[str]) -> None:
        self.counts = counts
        self.total: Counter[str] = Counter()
        self.kinds: Counter[str] = Counter()
        for g, c in counts.items():
            self.total[g[:-1]] += c
            self.kinds[g[:-1]] += 1
        self.known: dict[str, float] = {}

    def p(self, gram: str) -> float:
        """Probability of the last character after the ones before."""
        got = self.known.get(gram)
        if got is None:
            lower = self.p(gram[1:]) if len(gram) > 1 else 1e-4
            context = gram[:-1]
            n = self.total.get(context, 0)
            if n:
                t = self.kinds[context]
                got = (self.counts.get(gram, 0) + t * lower) / (n + t)
            else:
                got = lower
            if len(self.known) < 500_000:
                self.known[gram] = got
        return got

    def bits(self, text: str) -> float:
        """Mean log2 probability of a character of ``text``."""
        return sum(math.log2(self.p(text[max(0, i - N + 1) : i + 1])) for i in range(1, len(text))) / max(1, len(text) - 1)


def grams(text: str) -> Iterator[str]:
    for i in range(1, len(text)):
        for k in range(1, N + 1):
            if i - k + 1 >= 0:
                yield text[i - k + 1 : i + 1]


def count_grams(texts: Iterable[str]) -> Counter[str]:
    total: Counter[str] = Counter()
    for t in texts:
        total.update(grams(normal(t)))
    return total


def prose_counts(df: DataFrame, column: str, most: int = 2_000_000) -> Counter[str]:
    """Character n-grams of the corpus, counted over all documents.

    Every task counts its documents and drops nothing; the sums are reduced by
    key. A document weighs as the square of its words, up to ``FULL`` of them: a
    page of a few words says little about prose, however often it was crawled. The
    n-grams lie within words and have four signs at most, so their number is that
    of the scripts' syllables; more than ``most`` of them are refused, none is left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.string()), ("n", pa.float64())])
        distinct: dict[str, float] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    own = normal(t).split()
                    weight = min(1.0, len(own) / FULL) ** 2
                    for w, c in Counter(own).items():
                        distinct[w] = distinct.get(w, 0.0) + c * weight
        total: dict[str, float] = {}
        for w, c in distinct.items():  # grams within a word and its borders, once for each distinct word
            for g in grams(f" {w} "):
                total[g] = total.get(g, 0.0) + c
        if total:
            yield pa.RecordBatch.from_pydict({"g": list(total), "n": list(total.values())}, schema=schema)

    ship_package(df.sparkSession)
    rows = df.select(column).mapInArrow(count, "g string, n double").groupBy("g").agg(F.round(F.sum("n"), 3).alias("n"))
    found = rows.limit(most + 1).toArrow()
    if found.num_rows > most:
        raise ValueError(f"more than {most} character n-grams; raise the limit if the driver and the tasks have the memory")
    return Counter(dict(sorted(zip(found.column("g").to_pylist(), found.column("n").to_pylist()))))


class ResidueModel:
    """Likelihood-ratio windows over the pieces of a text."""

    def __init__(self, prose: Counter[str], least: float = 0.9) -> None:
        by_word = lambda seeds: sum((count_grams(w for w in line.split()) for line in seeds.split("\n")), Counter())
        self.prose = NgramModel(prose)
        self.filler, self.notice = NgramModel(by_word(FILLER)), NgramModel(by_word(NOTICES))
        self.least = least
        self.strange = -2.8
        self.ratios: dict[str, tuple[float, float]] = {}
        # A seed line whose words all occur is a phrase of that class.
        lines = {kind: [normal(x).split() for x in seeds.strip().split("\n")] for kind, seeds in (("filler", FILLER), ("notice", NOTICES))}
        # Words of the seeds by number; 0 is any other word, 1 and 2 the ends of a piece.
        self.seed = {w: i for i, w in enumerate(sorted({w for ws in lines.values() for line in ws for w in line}), 3)}
        self.pairs = {}
        for kind, ws in lines.items():
            known = np.zeros((len(self.seed) + 3,) * 2, bool)
            for line in ws:
                ids = [1, *(self.seed[w] for w in line), 2]
                known[ids[:-1], ids[1:]] = True
            self.pairs[kind] = known

    def word(self, w: str) -> tuple[float, float]:
        """Log-likelihood ratios (bits a character) of a word: filler to prose, notice to prose."""
        got = self.ratios.get(w)
        if got is None:
            t = f" {w} "
            base = self.prose.bits(t)
            own = self.filler.bits(t), self.notice.bits(t)
            # A word that is new to all models is evidence of nothing.
            got = tuple(x - base if x >= self.strange else min(0.0, x - base) for x in own)
            if len(self.ratios) < 200_000:
                self.ratios[w] = got
        return got

    def score_all(self, texts: list[str]) -> list[dict[str, float | bool]]:
        """Coverage of texts by filler and by notices, and whether a placeholder is there.

        Every distinct word is scored once; the pieces of all texts are scored together.
        """
        number: dict[str, int] = {}
        pieces: list[list[int]] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            for part in PIECE_END.split(_NUMBERS.sub("0", text.lower())):
                words = _TOKEN.findall(part)
                if words:
                    pieces.append([number.setdefault(w, len(number)) for w in words])
                    owner.append(i)
        names = list(number)
        letters = np.array([0 if "0" in w else len(w) for w in names], np.int64)  # numbers and reference codes say nothing
        blank = number.get("0", -1)
        ratio = np.array([(0.0, 0.0) if w == "0" else self.word(w) for w in names]).reshape(-1, 2)
        size = np.array([0 if w == "0" else len(w) + 1 for w in names], np.float64)
        seed = np.array([self.seed.get(w, 0) for w in names], np.int64)
        covered = {kind: np.zeros(len(texts)) for kind in ("filler", "notice")}
        total, run_letters = np.zeros(len(texts)), np.zeros(len(texts))
        own = np.array(owner, np.int64)
        if pieces:
            flat = np.fromiter((w for p in pieces for w in p), np.int64)
            length = np.array([len(p) for p in pieces])
            start = np.concatenate([[0], np.cumsum(length)[:-1]])
            n = np.add.reduceat(letters[flat], start)
            filler, notice, best = self._scores(flat, start, length, blank, ratio, size, seed)
            live = n > 0
            np.add.at(total, own[live], n[live])
            is_filler = filler >= notice
            hit = live & (np.maximum(filler, notice) >= self.least)
            for kind, of in (("filler", hit & is_filler), ("notice", hit & ~is_filler)):
                np.add.at(covered[kind], own[of], n[of])
            whole = hit & is_filler & (length > 1)
            np.add.at(run_letters, own[whole], n[whole])
            # A window of filler needs a word of such a ratio, or a run of seed pairs.
            high = np.maximum.reduceat(ratio[flat, 0], start) >= 0.6
            for k in np.flatnonzero(live & ~hit & (length > 5) & (high | (best >= 4))):
                part = self.window([names[w] for w in pieces[k]], int(best[k]))
                covered["filler"][own[k]] += part
                run_letters[own[k]] += part
        total = np.maximum(1, total)
        return [
            {"filler_share": float(covered["filler"][i] / total[i]), "notice_share": float(covered["notice"][i] / total[i]), "filler_chars": int(run_letters[i]), "placeholder": placeholder(t)}
            for i, t in enumerate(texts)
        ]

    def _scores(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, blank: int, ratio: np.ndarray, size: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every piece the score for filler and for notices, and its longest run of word pairs of filler.

        A score is the mean word ratio, raised by the share of word pairs that stand
        in a seed of that class.
        """
        kept = flat != blank
        count = np.add.reduceat(kept.astype(np.int64), start)
        weight = np.add.reduceat(size[flat], start)
        piece = np.repeat(np.arange(len(start)), length)
        words, of = flat[kept], piece[kept]
        first = np.searchsorted(of, np.arange(len(start)))
        some = count > 0
        # Ends of the pieces are set between their words: ^ a b $
        ids = np.full(len(words) + 2 * int(some.sum()), 0, np.int64)
        shift = np.cumsum(some)[of]  # pieces up to this one
        at = np.arange(len(words)) + 2 * shift - 1
        ids[at] = seed[words]
        opens = (first + 2 * (np.cumsum(some) - 1))[some]
        ids[opens] = 1
        ids[opens + count[some] + 1] = 2
        out = []
        same = np.zeros(len(start), bool)
        if len(words):
            low, high = (f.reduceat(words, np.minimum(first, len(words) - 1)) for f in (np.minimum, np.maximum))
            same = some & (count >= 3) & (low == high)
        for k, kind in enumerate(("filler", "notice")):
            mean = np.add.reduceat(ratio[flat, k] * size[flat], start) / np.maximum(weight, 1)
            pair = np.append(self.pairs[kind][ids[:-1], ids[1:]], False)
            share = np.zeros(len(start))
            if len(opens):
                sums = np.concatenate([[0], np.cumsum(pair)])
                share[some] = (sums[opens + count[some] + 1] - sums[opens]) / (count[some] + 1)
            known = np.where((share >= 0.8) & (count > 2), self.least, mean)  # word for word a seed
            score = np.maximum(np.maximum(mean + 0.3, mean + 4 * share - 1.5), known)
            out.append(np.where(some, np.where(same, 2 * self.least if k == 0 else 0.0, score), 0.0))
        # Runs of pairs between the words of a piece, numbers included.
        inner = np.append(self.pairs["filler"][seed[flat[:-1]], seed[flat[1:]]], False)
        inner[start[1:] - 1] = False
        reset = np.maximum.accumulate(np.where(inner, 0, np.arange(1, len(flat) + 1)))
        runs = np.arange(1, len(flat) + 1) - reset
        return out[0], out[1], np.maximum.reduceat(runs, start)

    def window(self, words: list[str], run: int) -> int:
        """Letters of the best window of filler inside a piece that is not filler as a whole; ``run`` word pairs of it stand in a row in a seed."""
        if run >= 4:
            return 4 * run
        ratio = [self.word(w)[0] for w in words]
        total = letters = start = 0.0
        found = 0
        for i, (w, r) in enumerate(zip(words, ratio)):  # the contiguous words of greatest summed ratio beyond .3 a letter
            if total <= 0:
                total, letters, start = 0.0, 0, i
            total += (r - 0.3) * len(w)
            letters += len(w)
            if i - start >= 3 and total >= 0.3 * letters:
                found = max(found, int(letters) if letters >= 12 else 0)
        return found

    def score(self, text: str) -> dict[str, float | bool]:
        """The same for one text."""
        return self.score_all([text])[0]


def residue(df: DataFrame, key: str = "doc_id", column: str = "text", *, least_ratio: float = 0.9, notice_cover: float = 0.6, filler_chars: int = 8) -> DataFrame:
    """Score every document: ``key``, ``filler_share``, ``notice_share``, ``placeholder``, ``residue``.

    ``residue`` is true for an open placeholder, for windows of filler with at
    least ``filler_chars`` letters together, and for a text of which notices cover
    ``notice_cover`` or more. Null and empty texts have no residue. Whole texts
    are read; apart from the n-gram counts nothing is shuffled.
    """
    prose = prose_counts(df, column)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ResidueModel(prose, least_ratio)
        for b in batches:
            out = model.score_all([t or "" for t in b.column(1).to_pylist()])
            bad = [s["placeholder"] or s["filler_chars"] >= filler_chars or s["notice_share"] >= notice_cover for s in out]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([s[c] for s in out], pa.float64()) for c in ("filler_share", "notice_share")), pa.array([s["placeholder"] for s in out], pa.bool_()), pa.array(bad, pa.bool_())],
                names=[key, "filler_share", "notice_share", "placeholder", "residue"],
            )

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, filler_share double, notice_share double, placeholder boolean, residue boolean")

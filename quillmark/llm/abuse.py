"""Problem 3: abusive, hateful or sexual content.

Method: Levenshtein automata intersected with a lexicon trie find abusive terms
in any spelling; the words in a window around a hit tell whether it is said to
somebody, quoted, or harmless. Harm that is wished, demanded or announced is told
from the words around a harm word; statements against groups and other abuse that
needs no bad word are word frames, a departure from the method, scored the same way.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.lookalike import Rewriter, classes
from quillmark.operators.latest import latest_by
from quillmark.session import ship_package

LEAST = 0.5
WINDOW = 6

# Insults by language; all are written as they are folded (lower case, no accents).
INSULTS = """
idiot idiots moron morons imbecile dimwit halfwit loser losers bastard bastards scumbag scumbags scum bitch whore slut asshole arsehole
dickhead prick cunt wanker twat jerk pig swine parasite vermin cockroach cockroaches rat rats clown fool stupid retard retarded
dumbass jackass douchebag creep coward trash garbage filth worthless pathetic brainless fucker motherfucker shithead bullshit fuck fucking piss
idiota idiotas imbecil imbeciles gilipollas cabron cabrones payaso pendejo puta puto mierda zorra subnormal capullo maricon hijueputa estupido
abruti cretin connard connasse salaud salope debile encule batard merde pute ordure cretine conne espece
arschloch vollidiot trottel drecksack missgeburt wichser hurensohn schlampe fotze scheisse penner schwachkopf depp dummkopf schweinehund
otario babaca canalha imbecil idiota merda caralho filho-da-puta arrombado vagabunda corno burro nojento
kamina kamine harami haramkhor gadha gadhe ullu bewakoof kutta kutte chutiya madarchod bhenchod saala randi suar nalayak
naaye naayi porukki loosu muttaal kazhudhai thevdiya punda otha mayiru erumai panni sombu
कमीना कमीने हरामी गधा गधे उल्लू बेवकूफ कुत्ता कुत्ते चूतिया मादरचोद रंडी सूअर नालायक साला
நாயே நாய் பொறுக்கி லூசு முட்டாள் கழுதை தேவடியா எருமை பன்னி
"""
# More insults, mostly of British, American, Australian and Indian English and of general slang.
INSULTS += """
numpty tosser wally muppet plonker pillock prat bellend knobhead twit nitwit dunce dolt dullard oaf buffoon blockhead numbskull knucklehead airhead bonehead cretinous simpleton ignoramus
scoundrel lowlife weasel sleazebag sleazeball slimeball dirtbag douche shithole pisshead arsewipe asswipe asshat dipshit numbnuts dickwad fuckwit fuckface cocksucker bugger sod wretch wench skank hussy
drongo bogan dropkick deadbeat freeloader leech crybaby weirdo freak psycho lunatic nutcase nutjob halfwits nitwits dimwits morons cowards freaks weirdos
huevon boludo pelotudo gilipolla mamon cretino desgraciado sinverguenza malparido cagon baboso
enfoire bouffon bolosse tocard minable salopard putain raclure
spasti vollpfosten hornochse dreckskerl mistkerl armleuchter flachzange pfeife knallkopf
palhaco imprestavel desgracado cretina safado trouxa
bakwaas nikamma gawaar ghatiya kameeni bevda
"""
# What is done or wished to people, as it is folded; matched exactly, as many have ordinary neighbours (drowned, crowned).
HARM_WORDS = set("kill killed die dies died dead drown drowned drowns hang hanged burn burned burnt burns shoot shot stab stabbed lynch lynched bury buried choke chokes rot rots suffer suffers crushed smash bleed gassed whipped strangle strangled butcher slaughter slaughtered exterminated beaten murdered murder poison poisoned flogged cancer coffin grave ambulance floods collapses".split())
# Harm that is a threat only where somebody is its object.
HARM_VERBS = HARM_WORDS | set("end beat hurt break crush cut slap punch destroy finish ruin hunt".split())
# Words that wish, and words that demand.
WISHES, DEMANDS = set("hope wish hoping wishing pray praying".split()), set("should must deserve deserves ought needs need".split())
# People as objects or owners; who threatens and how; what takes a threat back.
PEOPLE = set("you your yours u ya yourself them they those these people him her his he she everyone lot".split())
OBJECT_PEOPLE = set("you u ya them him her everyone".split())
THREATENERS, INTENT = set("i we ill we'll i'll".split()), set("will ll gonna going shall ill we'll i'll".split())
TAKEN_BACK = set("not never no dont don't won't wouldn't nobody if without from because who".split())
# Words of contests, in which people are beaten or destroyed without harm.
CONTEST = set("final finals semifinal game games match matches run runs goal goals point points race team teams series cup league tournament election quiz score wicket wickets innings record season round set sets chess".split())
# Terms of sexual talk.
SEXUAL = """
porn porno pornography xxx xx nude nudes naked boobs tits pussy cock dick horny sexy sex undress escort escorts hookup fetish blowjob
cams uncensored orgasm camgirl onlyfans strip lick nackt nackte desnuda desnudas nue nues pelada peladas nangi
नंगी नंगा सेक्सी செக்ஸ் நிர்வாண
"""
# Words that are abusive only as part of the frames below.
MILD = {"stupid", "pig", "rat", "rats", "vermin", "parasite", "cockroach", "cockroaches", "clown", "fool", "trash", "garbage", "filth", "worthless", "pathetic", "brainless", "jerk", "creep", "coward", "swine", "payaso", "espece", "burro", "nojento", "debile", "gadha", "gadhe", "ullu", "kutta", "kutte", "suar", "erumai", "panni", "loosu", "naayi", "kazhudhai", "गधा", "गधे", "उल्लू", "कुत्ता", "कुत्ते", "सूअर", "साला", "நாய்", "கழுதை", "எருமை", "பன்னி", "sombu", "lick", "strip", "cock", "dick", "cams", "escort", "escorts", "sex", "sexy", "naked", "undress", "piss", "prick", "scum", "losers", "idiots", "nue", "nues", "otha", "punda", "depp", "penner", "ordure", "conne", "cretin", "corno", "puta", "puto", "mierda", "merda", "merde", "saala", "xxx", "xx", "uncensored", "fetish", "pelada", "peladas", "zorra", "capullo"}
# Ordinary words one letter away from a term.
ORDINARY = set(
    "price prices paani naali naanga closer lower loose losers lose looser poser rate rates rates' ratio bat cat cats hat hats mat mats rat's sat fat eat eats art arts bats pit pick trick brick bricks sock lock clock rock dock block cook cooks cocktail class glass assessment assess pass mass grass bass "
    "tips tip tits' ties tics bits bit hits hit kits kit sits sit its fits pits tins tin "
    "big dig fig pin pie peg wig rig jig clan clown's crown blown brown flown coward's cowards toward towards forward steward reward "
    "sexta sexto seis sex's set sect text next vex six "
    "scam scams came cam camp camps games dams jams slip strips stripe trip script strict string "
    "pute pure cute mute lute puts put puta's punta puro puntos pudo pude juta ruta fruta "
    "conner connue connu conseil connard's colonne canne bonne donne sonne tonne "
    "cretina secret "
    "kutti kuttu gadi gaadi gaada gandi ganda garbh saal saale sala salaam saath randhi rand "
    "panna panni's pannu pannai nayi nayaa naya nai "
    "fool's fools pool tool food foot wool cool school spool foul full "
    "porto ponto perno corno's horno torno forno ports port sport poro polo porn's corn born torn worn horn morn "
    "nudge rude dude node made nada nude's "
    "line lines like lick's licked sick pick tick kick wick luck lack lock slick click flick "
    "creed creek crepe crews steep cheep "
    "tramp cramp crash brash trust trash's thrash track "
    "filthy filter filtro faith fifth fil fille filles fils film films "
    "burro's barro bairro churro curro forro ferro zorro perro perros cerro "
    "merda's mercado merced mermar tierra miedo piedra merci mere mer "
    "stupa morons' moon maroon mormon bitte bitten bites biche beach batch ditch pitch witch hitch stitch "
    "peniel spinner planner penne tenner renner rentner deep dep depot "
    "otra otro obra oeuvre hora ostra ochra otha's "
    "cabana cabra carbon cabo tabron capullo's canal canalhas canela "
    "whose shore where whole chore store score more "
    "dick's disk dice duck deck nick rick "
    "swing swim twine wine seine spine shine "
    "idiom idea idol idiosa "
    "puny punta punga pandal banda punt fund "
    "escolta escort's resort report effort export support "
    "hurens hookup's "
    "erum erumbu soap sambo combo bombo sombo sombra "
    "bastar bastante bastard's custard mustard "
    "naan naal naam naa aana "
    "nua nie nueve nuevo rue une que vue due sue que' "
    "zorra's sorry "
    "otario's horario notario otoño "
    "fatto nackte's nachte nacht nachts machte knackte packte".split()
)
# Signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i", "+": "t"}

# Words that say a term to somebody, by language.
SECOND = set("you your youre yours u ur yourself du dich dein deine dir ihr tu te toi ton ta vous eres tus tú ti vos voce você seu sua tua teu és es tum tumhara tumhari tera teri tere tujhe aap nee unakku un unga ni poda podi vaaya da di तू तुम तेरा तेरी तुझे நீ உன் உனக்கு".split())
HOSTILE = set("shut get lost such what only every this so halt verpiss fresse maul cala cállate callate some daqui ferme va crever casse quel quelle sale que qué tan un una vrai chup kar ekdum aise joote maaro ellam manushane illa moodu gehört verprügelt hope deserve ugly stupid filthy disgusting rotten pathetic worthless brainless talks again nobody asked would write this face mouth swallow".split())
QUOTING = set("called calling said says word words report reported reporting stop stopped term quote quoted slur slurs abuse abusive condemn wrong unfair nobody's apologise apologised apologized banned removed deleted headline lyrics dictionary meaning means llamar llamó llamaron dijo decir palabra palabras appeler appelé dit mot nannte genannt gesagt wort chamou chamar disse palavra kaha bola solli sonnan sonnaanga kehna".split())
# Words that, before a term or right after it, report it or speak of it as a word.
REPORTING = set("called calling calls call said says saying word words term quote quoted slur slurs means meaning llamar llamó llamaron dijo decir palabra palabras appeler appelé dit mot nannte genannt gesagt wort chamou chamar disse palavra kaha bola solli sonnan sonnaanga kehna".split())
# Who a term is said to, and what may stand between.
ADDRESSED = set("you youre you're u ya du tu vous eres você voce tum nee तू तुम நீ".split())
BETWEEN = set("are re r are such what a an the absolute complete total utter bloody fucking damn little old bist ein eine so un una es tan espece de".split())
# Words after a mild term that make it a verb.
OBJECTS = set("around about out it that this these those them him her me us up on off down with yourself into the your my our his their".split())
#: One-sided rates for a term's share of the score.
DIRECT, QUOTE = 0.45, 0.6

_G = r"(?:an? |every |all |any |those |these |the |them |other |such )?(?P<g>[^\W\d_]{3,})"
# Frames of threats, wishes of harm, degradation and solicitation, over folded words;
# each with its score and with substrings of which a text must hold one for the frame to match.
FRAMES: list[tuple[str, float, str]] = [
    # wishes of harm and threats
    (r"jump (?:in front of|off|under|from) (?:the|a) (?:next )?(?:train|bus|bridge|roof|cliff|truck)", 0.9, "jump"),
    (r"nobody would (?:miss|notice|cry)(?: \w+)? if you", 0.9, "nobody would"),
    (r"(?:i )?hope (?:you|your \w+) (?:lose everything|die|dies|rot|burns?|suffers?|chokes?|drowns?|crash(?:es)?|goes? (?:off|under|to hell)|gets? (?:hit|sick|hurt|cancer|run over)|never)", 0.9, "hope"),
    (r"(?:go )?choke on (?:your|it)", 0.8, "choke"),
    (r"(?:favou?r and |just |go )?(?:disappear|vanish) (?:for good|forever)", 0.75, "disappear|vanish"),
    (r"watch your back", 0.8, "watch your back"),
    (r"we (?:are|re) coming for you|we know where you (?:live|sleep)", 0.85, "coming for you|know where you"),
    (r"(?:i|we) (?:will|ll|am going to|are going to|gonna) (?:\w+ ){0,4}(?:break|smash|crush|cut|burn|kill|hurt|beat|bury|stab|shoot|slap|destroy) (?:your|you)\b", 0.9, "break|smash|crush|cut|burn|kill|hurt|beat|bury|stab|shoot|slap|destroy"),
    (r"you will (?:leave|end|go|be|wake)(?: \w+)? in (?:an ambulance|a coffin|a hospital|a ditch|hospital)", 0.9, "you will"),
    (r"(?:people|men|women|someone|anyone|everyone|pigs|scum) like (?:you|him|her|them) (?:deserve|should be|ought to be|need) (?:\w+ ){0,3}(?:beating|beaten|hanged|shot|slapped|whipped|punished|prison|death|killed|locked)", 0.9, " like you| like him| like her| like them"),
    (r"(?:should|must|ought to) be (?:hanged|lynched|shot|gassed|exterminated|whipped|beaten up)\b", 0.6, "hanged|lynched|shot|gassed|exterminated|whipped|beaten"),
    (r"you (?:should|must|deserve to) (?:die|rot|burn|hang|suffer)|kill yourself|kys|drop dead|rot in hell|burn in hell", 0.95, "you should|you must|deserve to|kill yourself|kys|drop dead|in hell"),
    (r"va crever|creve sale|verrecke|geh sterben|muerete|ojala te mueras|vai morrer|morra seu|mar ja|saavu da|sethu po|joote maaro|gehort verprugelt|gehort erschossen", 0.9, "crever|creve|verrecke|sterben|mueras|muerete|morrer|morra|mar ja|saavu|sethu|maaro|gehort"),
    # insults without a bad word
    (r"crawl back (?:under|into|to) (?:the|your|that) (?:rock|hole|cave|gutter|sewer)", 0.9, "crawl back"),
    (r"face like yours", 0.8, "like yours"),
    (r"(?:more|better|less) (?:sense|brains?|wit|use|manners) than you\b", 0.8, "than you"),
    (r"(?:smarter|brighter|cleverer|better) (?:things?|ones?|stuff|people|animals) (?:\w+ ){0,6}than you\b", 0.85, "than you"),
    (r"you smell worse|you are (?:a )?(?:waste of|mistake|disgrace|joke of)|you were a mistake|waste of (?:oxygen|air|skin)", 0.9, "you smell|you are|you were|waste of"),
    (r"your (?:mother|father|parents|family|mum|mom) (?:\w+ )?(?:must|should|will)(?: \w+)? (?:ashamed|regret|sorry)", 0.85, "ashamed|regret|sorry"),
    (r"(?:take|shut) your (?:\w+ )?(?:mouth|trap|face)(?: and swallow)?", 0.7, "your mouth|mouth|trap|face"),
    (r"should lose the microphone", 0.6, "microphone"),
    (r"nobody (?:asked|likes|wants|needs|loves) you\b", 0.6, "nobody"),
    (r"(?:what an? \w+ and )?what an? (?:ugly|stupid|disgusting|rotten|pathetic|filthy|worthless|brainless) (?:face|voice|person|mouth)", 0.85, "what a"),
    (r"this (?:ugly|stupid|disgusting|rotten|pathetic|filthy|worthless|brainless) \w+ (?:talks|writes|posts|speaks|barks) again", 0.85, " again"),
    (r"only an? (?:ugly|stupid|disgusting|rotten|pathetic|filthy|worthless|brainless) \w+ (?:would|could|can) ", 0.8, "only a"),
    (r"you are such an? (?:ugly|stupid|disgusting|rotten|pathetic|filthy|worthless|brainless)", 0.85, "you are such"),
    (r"(?:one|a|two) (?:good |hard |tight )?(?:slap|punch|kick|bullet|beating|stone) would (?:fix|teach|shut|help|solve|silence)", 0.85, "slap|punch|kick|bullet|beating|stone"),
    (r"(?:that|this) (?:\w+ )?(?:head|face|mouth|brain|mug|tongue) of yours", 0.75, "of yours"),
    # statements against a group
    (r"are an? (?:disease|plague|cancer|curse|stain|infection|burden|pest) (?:and|on|to|of|in|that)", 0.9, " are a"),
    (r"must (?:all )?be (?:thrown|driven|kicked|wiped|chased|hunted) (?:out|away|down)", 0.75, "must"),
    (rf"(?:those|these|all|the) {_G} are (?:all )?(?:\w+ )?(?:cockroaches|rats|vermin|animals|pigs|dogs|parasites|lice|scum|thieves|dirt|filth|apes|monkeys|subhuman)", 0.95, " are "),
    (r"are (?:cockroaches|rats|vermin|animals|pigs|parasites|lice|scum) and must be", 0.95, "must be"),
    (r"because they are all (?:thieves|liars|criminals|rapists|animals|terrorists|dirty)", 0.9, "because they are"),
    (rf"never (?:rent|sell|hire|trust|marry|lend|serve)(?: to| from| with)? {_G} because", 0.85, "never"),
    (r"(?:families|people|women|they) breed like \w+", 0.9, "breed"),
    (rf"typical {_G} blood|blood dirty to the bone|dirty to the bone", 0.9, "blood|bone"),
    (rf"send (?:every|all|those|these|the) {_G} back (?:where|to where|home|to)", 0.85, "send "),
    (rf"\bno {_G} (?:should be|must be|are|is) (?:allowed|welcome|permitted)(?: \w+)? (?:near|in|into|on|at) our", 0.85, "near our|into our|in our|at our|on our"),
    (rf"we do not (?:serve|hire|rent to|sell to|want|allow) {_G} here(?: and never will)?", 0.85, "we do not"),
    (rf"(?:a|the only) good {_G} is an? (?:gone|dead) (?P=g)", 0.95, "gone|dead"),
    (r"(?:cleanse|purge|rid|free) (?:this|our|the) (?:town|city|country|village|land|street|area|nation) of ", 0.85, " of "),
    (rf"do not let your (?:daughters?|sons?|children|sisters?|kids) (?:marry|date|meet|play with|near) {_G}", 0.85, "do not let"),
    (r"(?:kids|children|people|families) should be kept out of our", 0.85, "kept out"),
    (r"(?:are|is) not (?:even )?(?:human|people)\b|manushane illa|manusha(?:n|ne) illa|मनुष्य नहीं|மனுஷனே இல்லை|insaan (?:hi )?nahi|keine menschen", 0.85, "are not|is not|manush|insaan|मनुष्य|மனுஷன|menschen"),
    # sexual talk and solicitation
    (r"(?:send|show|see|want|share|give) (?:\w+ ){0,5}(?:nudes?|naked|boobs|tits|pussy|ass|undressed)\b", 0.9, "nude|naked|boobs|tits|pussy|ass|undress"),
    (r"(?:lick|kiss|touch|taste|undress|spank) you (?:all over|everywhere|down there|slowly|tonight)", 0.9, "you all over|everywhere|down there|slowly|tonight"),
    (r"what are you wearing under", 0.85, "wearing"),
    (r"(?:come|climb) (?:over )?(?:and|to) (?:ride|warm|please|undress|sleep with) me|my bed is (?:cold|empty|warm)", 0.85, "ride me|warm me|please me|undress|sleep with|my bed"),
    (r"(?:horny|sexy|hot|naked|lonely|wild) (?:singles|girls|women|moms?|milfs?|boys|teens|ladies|babes) (?:\w+ ){0,6}(?:wait|want|chat|near|online|link|tonight|meet|message)", 0.9, "horny|sexy|hot |naked|lonely|wild"),
    (r"(?:dirty|naughty|hot) (?:fun|talk|chat|games|pics|photos|clips)(?: \w+){0,8} (?:undress|naked|nude|text me|message me|tonight)", 0.85, "undress|naked|nude|text me|message me|tonight"),
    (r"(?:free|uncensored|watch|live|hot) (?:\w+ ){0,2}(?:porn|xxx?|sex|nude) (?:\w+ ){0,2}(?:cams?|clips?|videos?|chat|movies?|pics|channel|show)", 0.95, "porn|xx|sex|nude"),
    (r"(?:porn|xxx?|sex) (?:cams?|clips?|videos?|chat)", 0.9, "porn|xx|sex"),
    (r"(?:she|he) (?:likes|loves|wants|takes) it (?:rough|hard|deep|dirty)", 0.9, "rough|it hard|it deep|it dirty"),
    (r"(?:envia|enviame|manda|mandame|muestrame|ensename) (?:\w+ ){0,3}(?:desnuda|desnudas|tetas|culo)|(?:zeig|schick) mir (?:\w+ ){0,3}(?:titten|nackt|nacktbilder|brueste)|(?:envoie|montre)(?: moi)? (?:\w+ ){0,3}(?:nue|nues|seins|nudes)|(?:manda|me manda) (?:\w+ ){0,2}(?:nudes|pelada|peitos)|nangi (?:photo|photos|pics)|kapde utaar", 0.9, "desnuda|tetas|culo|titten|nackt|brueste|nue|seins|nudes|pelada|peitos|nangi|kapde"),
    # orders to be silent and name-calling in Indic languages
    (r"chup kar \w+ kahin ka|चुप कर \S+ कहीं का", 0.8, "kahin ka|कहीं का"),
    (r"tu ekdum \w+ (?:aur|hai)|तू एकदम \S+ (?:और|है)", 0.75, "ekdum|एकदम"),
    (r"vaaya moodu \w+|வாயை மூடு", 0.75, "vaaya moodu|வாயை மூடு"),
    (r"nee oru \w+ poda|நீ ஒரு \S+ போடா", 0.8, " poda|போடா"),
    (r"जूते मारो|செருப்பால்", 0.85, "जूते|செருப்பால்"),
]
FRAME_RES = [(re.compile(rf"(?<!\w)(?:{p})"), s) for p, s, _ in FRAMES]

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*", re.UNICODE)
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_](?:[\s.\-_*·]{1,2})){2,}[^\W\d_](?![^\W_])")
_DISGUISED = re.compile(r"(?=[^\s]*[^\W\d_])(?=[^\s]*[\d@$!€|+*#.\-_])[\w@$!€|+*#.\-]{3,24}")
_LONG = re.compile(r"([^\W\d_])\1{2,}")


def fold(word: str) -> str:
    """Lower case without accents (marks of Indic scripts stay)."""
    if word.isascii():
        return word.lower()
    apart = unicodedata.normalize("NFD", word.lower().replace("ß", "ss"))
    return unicodedata.normalize("NFC", "".join(c for c in apart if not "̀" <= c <= "ͯ"))


class Lexicon:
    """A trie of terms, walked together with the Levenshtein automaton of a word.

    A node of the walk is a trie node and the automaton's state: for each number of
    edits the prefixes of the word that are reached, as the bits of one integer, so
    a letter of the trie is a few shifts. A branch ends where no prefix is left.
    """

    def __init__(self, terms: dict[str, tuple[str, float]]) -> None:
        self.terms = terms
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        self.known: dict[str, tuple[str, int] | None] = {}

    def edits(self, word: str) -> int:
        """Edits allowed for a word of that length; short words must match exactly."""
        n = len(word)
        return 0 if n < 5 else 1 if n < 9 else 2

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within the allowed edits, with its distance."""
        if word in self.known:
            return self.known[word]
        found = self._match(word)
        if len(self.known) < 300_000:
            self.known[word] = found
        return found

    def _match(self, word: str) -> tuple[str, int] | None:
        if word in self.terms:
            return word, 0
        if word in ORDINARY:
            return None
        limit = self.edits(word)
        if not limit:
            return None
        best: tuple[str, int] | None = None
        first = self.root.get(word[0])
        if first is None:  # a change of the first letter makes another word
            return None
        n = len(word)
        whole, end = (1 << (n + 1)) - 1, 1 << n
        at: dict[str, int] = {}  # letter -> lengths of the word's prefixes that end with it
        for i, c in enumerate(word, 1):
            at[c] = at.get(c, 0) | 1 << i
        # State: for 0, 1, 2 edits the lengths of the word's prefixes reached with at most so many, as bits; and the state before.
        stack = [(first, (2, 7 & whole, 15 & whole), word[0], (1, 3 & whole, 7 & whole))]
        while stack:
            node, (r0, r1, r2), last, (b0, b1, _) = stack.pop()
            turned = at.get(last, 0)
            for c, child in node.items():
                if c == "":
                    distance = 0 if r0 & end else 1 if r1 & end else 2 if limit == 2 and r2 & end else 3
                    if distance <= limit and len(child) >= 4 and (best is None or distance < best[1]) and not _inflected(word, child):
                        best = child, distance
                    continue
                m = at.get(c, 0)
                swap = turned & m << 1  # the word has these two letters the other way round
                n0 = r0 << 1 & m
                n1 = (r1 << 1 & m | r0 | r0 << 1 | n0 << 1 | b0 << 2 & swap) & whole
                if limit == 1:
                    if n1:
                        stack.append((child, (n0, n1, 0), c, (r0, r1, r2)))
                    continue
                n2 = (r2 << 1 & m | r1 | r1 << 1 | n1 << 1 | b1 << 2 & swap) & whole
                if n2:
                    stack.append((child, (n0, n1, n2), c, (r0, r1, r2)))
        return best


def _inflected(word: str, term: str) -> bool:
    """An ordinary word that merely starts like a short term, e.g. a longer noun."""
    return len(term) <= 5 and abs(len(word) - len(term)) == 1 and not (word.startswith(term) and word[-1] in "sz")


def lexicon() -> Lexicon:
    terms: dict[str, tuple[str, float]] = {}
    for kind, text, weight in (("insult", INSULTS, 0.5), ("sexual", SEXUAL, 0.5)):
        for w in text.split():
            f = fold(w)
            terms[f] = (kind, 0.2 if w in MILD or f in MILD else weight)
    return Lexicon(terms)


_ADJECTIVES = set("ugly stupid disgusting rotten pathetic filthy worthless brainless".split())
_FRAME_WORDS = _ADJECTIVES | {"naked", "nude", "boobs", "tits", "porn", "horny", "sexy", "cockroaches", "vermin", "rats", "animals", "undress"}


def harm(tokens: list[str], i: int) -> float:
    """Score of the harm word at ``i`` by what stands around it: a threat to somebody, a wish for somebody, a demand about somebody."""
    before = tokens[max(0, i - 7) : i]
    after = tokens[i + 1 : i + 3]
    if any(x in TAKEN_BACK for x in before[-5:]) or any(x in QUOTING for x in before) or any(x in CONTEST for x in tokens[max(0, i - 4) : i + 9]):
        return 0.0
    if any(x in OBJECT_PEOPLE for x in after[:1]) and any(x in THREATENERS for x in before[-4:]) and any(x in INTENT for x in before[-3:]):
        return 0.9
    if tokens[i] not in HARM_WORDS:
        return 0.0
    for at, x in enumerate(before):
        if x in WISHES and any(y in PEOPLE for y in before[at + 1 : at + 3]):
            return 0.85
        # 'those people should all be drowned': somebody close before the demand, the harm close after it
        if x in DEMANDS and any(y in PEOPLE for y in before[max(0, at - 2) : at]) and (len(before) - at <= 4) and ("be" in before[at + 1 :] or "to" in before[at + 1 :] or len(before) - at == 1):
            return 0.8
    return 0.0


class Scorer:
    """Scores a text for abuse; made once for each Python worker."""

    def __init__(self) -> None:
        import ahocorasick

        self.lexicon = lexicon()
        self.words = Lexicon({w: ("frame", 0.0) for w in _FRAME_WORDS})
        self.rewrite = Rewriter(classes({chr(i): 1000 for i in range(32, 127)} | {chr(i): 1 for i in range(0xFF01, 0xFF5F)}))
        self.frames = ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        for k, (_, _, keys) in enumerate(FRAMES):
            for x in keys.split("|"):
                owners.setdefault(x, []).append(k)
        for x, ks in owners.items():
            self.frames.add_word(x, ks)
        self.frames.make_automaton()
        self.ordinary = {_LONG_PAIR.sub(r"\1", w) for w in ORDINARY}
        self.info: dict[str, tuple[str, int] | str | None] = {}

    def token(self, w: str) -> tuple[str, int] | str | None:
        """What a token is: a lexicon hit, a frame word it disguises, or None."""
        try:
            return self.info[w]
        except KeyError:
            pass
        bare = w.strip("'’-*_")
        got: tuple[str, int] | str | None = None
        if len(bare) > 1:
            got = self.lexicon.match(bare)
            if not got and bare not in ORDINARY and _LONG_PAIR.search(bare):
                short = _LONG_PAIR.sub(r"\1", bare)
                if short in self.lexicon.terms or short not in self.ordinary:
                    got = self.lexicon.match(short)
            near = self.words.match(bare) or (self.words.match(_LONG_PAIR.sub(r"\1", bare)) if _LONG_PAIR.search(bare) else None)
            if near and near[0] != bare and not (got and got[0] == bare):
                got = near[0]
        if len(self.info) < 500_000:
            self.info[w] = got
        return got

    def plain(self, text: str) -> str:
        """Lower case, look-alikes and disguises undone."""
        t = fold(self.rewrite(text))
        t = _LONG.sub(r"\1\1", t)
        if _APART_HINT.search(t):
            t = _APART.sub(lambda m: re.sub(r"[\s.\-_*·]", "", m.group()), t)
        if _HIDDEN.search(t):
            t = _DISGUISED.sub(lambda m: self.unmask(m.group()), t)
        return t

    def unmask(self, word: str) -> str:
        """A word with signs in it, as the term it disguises; else unchanged."""
        core = word.strip(".-_!+|#")
        if "*" in core or "#" in core:
            shape = re.compile("".join("." if c in "*#" else re.escape(c) for c in core) + r"\Z")
            loose = re.compile(re.sub(r"(?:\.)+", "[^ ]+", "".join("." if c in "*#" else re.escape(c) for c in core)) + r"\Z")
            for t in [*self.lexicon.terms, *_FRAME_WORDS]:
                if len(t) == len(core) and shape.match(t):
                    return t
            for t in [*self.lexicon.terms, *_FRAME_WORDS]:
                if core[0] == t[0] and core[-1] == t[-1] and abs(len(t) - len(core)) <= 4 and len(t) >= 3 and loose.match(t):
                    return t
            return word
        if not any(c.isdigit() or c in "@$!€|+" for c in core):
            joined = re.sub(r"[.\-_]", "", core)
            parts = re.split(r"[.\-_]", core)
            return joined if max(map(len, parts)) <= 2 and (self.lexicon.match(joined) or self.words.match(joined)) else word
        swapped = "".join(LEET.get(c, c) for c in core)
        clear = re.sub(r"[^\w]", "", swapped)
        other = clear.replace("i", "l")
        for x in (clear, other):
            if x.isalpha() and (self.lexicon.match(x) or self.words.match(x)):
                return x
        return word

    def addressed(self, tokens: list[str], i: int) -> bool:
        """Whether the term at ``i`` is said to somebody: 'you X', 'you are such a X'."""
        if i + 1 < len(tokens) and tokens[i + 1] in OBJECTS:
            return False
        j = i - 1
        while j >= max(0, i - 4) and (tokens[j] in BETWEEN or tokens[j] in _ADJECTIVES):
            j -= 1
        return j >= 0 and tokens[j] in ADDRESSED

    def reported(self, tokens: list[str], i: int) -> bool:
        """Whether a reporting word governs the term at ``i``: up to four words before it, or 'X is a slur'."""
        return any(x in REPORTING for x in tokens[max(0, i - 4) : i]) or any(x in ("slur", "slurs", "word", "term") for x in tokens[i + 1 : i + 5])

    def score(self, text: str) -> tuple[float, list[str]]:
        """Score in 0..1 and the evidence found."""
        t = self.plain(text)
        tokens = [m.group() for m in _TOKEN.finditer(t)] if t.isascii() else re.findall(r"[^\s.,;:!?()\"“”।…\[\]]+", t)
        best, evidence = 0.0, []
        special = [(i, got) for i, w in enumerate(tokens) if (got := self.token(w)) is not None]
        for i, got in special:
            if isinstance(got, str):
                tokens[i] = got
                continue
            term, distance = got
            kind, weight = self.lexicon.terms[term]
            window = tokens[max(0, i - WINDOW) : i + 1 + WINDOW]
            close = tokens[max(0, i - 3) : i] + tokens[i + 1 : i + 3]
            said_to = self.addressed(tokens, i)
            s = weight - 0.05 * max(0, distance - 1)  # one edit is a plain misspelling
            if any(x in SECOND for x in close):
                s += DIRECT * 0.6
            if said_to and kind == "insult":
                s = max(s, LEAST)
            s += 0.12 * min(3, sum(x in HOSTILE or x in _ADJECTIVES for x in close))
            terms = sum(1 for j, h in special if j != i and abs(j - i) <= WINDOW and not isinstance(h, str) and self.lexicon.terms[h[0]][0] == kind)
            s += 0.2 * min(2, terms)
            if self.reported(tokens, i) if said_to else any(x in QUOTING for x in window):
                s -= QUOTE
            evidence.append(term)
            best = max(best, s)
        if not HARM_VERBS.isdisjoint(tokens):
            for i, w in enumerate(tokens):
                if w in HARM_VERBS and (s := harm(tokens, i)) > best:
                    best = s
                    evidence.append(w)
        joined = " ".join(tokens)
        for k in sorted({k for _, ks in self.frames.iter(joined) for k in ks}):
            frame, s = FRAME_RES[k]
            m = frame.search(joined)
            if m:
                before = joined[max(0, m.start() - 40) : m.start()].split()[-5:]
                if any(x in QUOTING for x in before):
                    s -= QUOTE
                best = max(best, s)
                evidence.append(m.group()[:60])
        return max(0.0, min(1.0, best)), evidence


_LONG_PAIR = re.compile(r"([^\W\d_])\1")
_APART_HINT = re.compile(r"(?<![^\W_])[^\W\d_][\s.\-_*·][^\W\d_][\s.\-_*·][^\W\d_](?![^\W_])")
_HIDDEN = re.compile(r"[^\W\d_][\d@$!€|+*#._\-]+[^\W\d_]")
def scored(df: DataFrame, key: str, column: str, time: str | None = None, source: str | None = None) -> DataFrame:
    """Score of every document: ``key``, (``source``), ``score`` in 0..1, ``evidence`` array<string>.

    Null texts score null, empty ones 0. Where ``time`` is given the latest row of
    a key counts; texts are scored where they are read, so they don't travel.
    """
    ship_package(df.sparkSession)
    kinds = dict(df.dtypes)
    at = F.lit(0).cast("long") if time is None else F.col(time)
    src = F.lit(None).cast("string") if source is None else F.col(source)
    at_type = "bigint" if time is None else kinds[time]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer()
        for b in batches:
            out = [(None, []) if t is None else s.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array([x for x, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.string()))], names=["k", "at", "src", "tie", "score", "evidence"])

    rows = df.select(F.col(key).alias("k"), F.col(column).alias("t"), at.alias("at"), src.alias("src"), F.xxhash64(column).alias("tie")).mapInArrow(run, f"k {kinds[key]}, at {at_type}, src string, tie bigint, score double, evidence array<string>")
    if time is not None:
        rows = latest_by(rows, ["k"], "at", [F.col("tie")])
    cols = [F.col("k").alias(key), *([F.col("src").alias(source)] if source else []), "score", "evidence"]
    return rows.select(*cols)


def rates(scores: DataFrame, source: str, least: float = LEAST) -> DataFrame:
    """For each source: posts with text, flagged posts, their rate and the mean score."""
    known = scores.filter("score is not null")
    flagged = F.sum((F.col("score") >= least).cast("long"))
    return known.groupBy(source).agg(F.count("*").alias("posts"), flagged.alias("flagged"), (flagged / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))

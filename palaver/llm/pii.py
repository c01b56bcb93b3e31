"""Personal data in free text: a semi-Markov conditional random field.

Whole spans are proposed as candidate segments by loose grammars (several types may claim
one span); features of the whole span and of its surroundings score each; dynamic
programming over the lattice of segments chooses boundaries and types jointly. The
weights are fitted by maximum conditional likelihood on generated lines with known
segments and with look-alikes (``pii_lines``): public forms of numbers with their check
digits, of addresses and of names of several countries, in carrier lines written for the
purpose. Whether a word is an ordinary one or a proper noun is read from the vocabularies of
public tokenizers: an ordinary word has a piece of its own in lower case.
"""

from __future__ import annotations

import base64
import math
import os
import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Frequent given names of several countries, titles, frequent surnames and ends of surnames, particles.
GIVEN = frozenset(
    """james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel lisa matthew
nancy anthony betty mark sandra emily oliver george harry jack amelia olivia rachel laura peter paul andrew simon hannah emma sophie alice
hans klaus jürgen stefan andreas sabine monika heike ursula petra lena jonas lukas anna katharina wolfgang
pierre jean michel claire camille antoine nathalie philippe isabelle julien chloé hugo
juan carlos miguel pablo carmen sofía marta javier lucía maría antonio josé
giovanni luca marco paolo giulia francesca chiara alessandro elena
joão pedro ana inês tiago beatriz rui
ivan sergei olga natalia tatiana
bram sanne lars astrid
mehmet ayşe emre
ahmed fatima omar ali hassan
raj priya amit sunita arjun deepa
wei chen hiroshi yuki akira minh thanh
chidi amara kwame""".split()
)
TITLES = frozenset("mr mrs ms miss mx dr prof sir herr frau hr fr m mme mlle monsieur madame mademoiselle sr sra srta señor señora señorita don doña dott dottoressa sig signor signora dra dona".split())
SURNAMES = frozenset("smith jones taylor brown williams johnson davies evans wilson thomas roberts walker wright robinson thompson white hughes edwards green hall lewis harris clarke müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch martin bernard dubois durand moreau laurent simon garcía fernández gonzález rodríguez lópez martínez sánchez pérez gómez rossi russo ferrari esposito bianchi romano silva santos ferreira pereira oliveira costa ivanov petrov smirnov kim nguyen tran wang li zhang khan singh patel sharma yılmaz demir".split())
ENDINGS = re.compile(r"(?:sky|ski|ska|czyk|wicz|vić|vic|ić|ova|eva|enko|chuk|yan|ian|oğlu|oglu|dottir|sson|sen|son|mann|berg|stein|burg|bach|feld|field|wood|worth|ham|ley|ton|ford|well|brook|man|ez|es|eira|ini|etti|elli|ucci|ano|aux|eau|oux|ard|ier|quist|ström|lund|mont|opoulos|idis|oui|ullah|wala|ov|ev|in)$")
PARTICLES = r"(?:van der|van den|van|von|zu|de la|de los|de|del|della|di|da|dos|du|le|el|al|bin|ter|den)"
_PARTS = frozenset(re.findall(r"\w+", PARTICLES))
STREET = r"(?:street|st\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|drive|dr\.?|court|close|crescent|square|boulevard|blvd\.?|terrace|way|row|gardens|mews|place|walk|hill|parkway|highway)"
# Words before a datum of a type, and words before numbers and names that are no data of a person.
CUES = {
    "phone": r"(?:tel|tél|téléphone|telefon|telefono|telefone|teléfono|móvil|celular|cellulare|portable|handy|phone|mobile|mobil|cell|whatsapp|fax|call|call me on|ring|text|dial|reach \w+ (?:on|at)|hotline|number is|number|numéro|nummer|número|numero|appelle\w*|appelez|joignable|anruf\w*|ruf\w*|rufen|erreichbar|llama\w*|chiama\w*|ligue|liga\w*|under|unter|al|au|on|at|pour)",
    "id_number": r"(?:ssn|social security|security number|national insurance|insurance number|nino|tax id|tax number|taxpayer|passport|passport number|driving licence|driver's license|licence|license|identity card|identity number|identity|id card|id number|id no|id|card number|card|iban|account|dni|nie|nif|curp|documento|pasaporte|ausweis\w*|personalausweis\w*|reisepass\w*|steuer\w*|rente\w*|versicherungs\w*|sozialversicherungs\w*|sécurité sociale|passeport|carte d'identité|codice fiscale|carta d'identità|cpf|rg|contribuinte|bsn|aadhaar|sin|patient|social)",
    "address": r"(?:address|live at|lives at|living at|living in|reside\w* at|deliver\w* to|deliver it to|send \w+ to|ship\w* to|post it to|home is|moved to|moved from|house at|flat at|office at|located at|based at|adresse|adresse est|domicilié\w*|habite\w*|livrer au|anschrift|wohn\w*|wohnt in der|wohnhaft|liefer\w* an|schicken an|dirección|domicilio|vivo en|vive en|enví\w+ a|indirizzo|abito in|abita in|spedi\w* a|endereço|moro na|mora na|resido na)",
    "name": r"(?:name|name is|named|names|i am|i'm|this is|dear|hi|hello|signed|sincerely|regards|yours|ask|asked|told|contact|meet|met|cc|attn|attention|author|by|to|from|with|for|about|and|behalf of|colleague|neighbour|neighbor|friend|boss|manager|teacher|tutor|lawyer|doctor|brother|sister|uncle|aunt|cousin|wife|husband|landlord|client|patient|m'appelle|je suis|cher|chère|par|avec|pour|nom|nom de|part de|à|collègue|voisin|voisine|ami|amie|heiße|bin|liebe|lieber|von|mit|an|für|kollege|kollegin|nachbar|nachbarin|namens|me llamo|soy|estimado|estimada|con|para|por|nombre|vecino|vecina|mi amigo|amiga|mi chiamo|sono|caro|cara|da|nome|per|collega|chamo|sou|prezado|prezada|com|colega|vizinho)",
    "tech": r"(?:version|release|v|build|commit|revision|port|line|lines|row|rows|page|pages|chapter|section|figure|table|step|error|error code|code|exit code|id of the order|order|order number|reference|ref|ticket|case|issue|invoice|receipt|batch|lot|item|sku|part|part number|serial|serial number|model|tracking|tracking number|parcel|isbn|doi|rfc|iso|checksum|hash|coordinates|latitude|longitude|timestamp|total|sum|amount|price|cost|costs|approximately|about|roughly|exactly|compute|calculate|multiply|divide|plus|minus|times|equals|between|population|year|years|since|ip|host|server|at offset|seed|epoch|euros|dollars|versión|pedido|factura|commande|facture|bestellung|bestellnummer|rechnung|auftrag|ordine|fattura|encomenda|fatura|referencia|référence|zeile|ligne|línea|riga)",
    "thing": r"(?:the|a|an|of|in|near|in the|using|use|uses|used|apply|applying|implement|method|methods|algorithm|called the|via|compare|comparing|versus|vs|like|city of|town of|visit|visiting|study|learn|learning|course|course on|game|film|movie|book|song|brand|company|team|project|library|tool|product|les|le|la|der|die|das|el|los|las|il|lo|gli|o|os|wizard|knight|hero|heroine|dragon|robot|cat|dog)",
}
LEFT = {k: re.compile(r"(?:^|[^\w])" + v + r"\s?[.:,]?\s?(?:->|=>|-|–|is|are|was|the|est|ist|es|è|é|of|nr\.?|no\.?|n°|#)?\s*[:,(=]?\s*[<(\"'«„“]?$", re.I) for k, v in CUES.items()}
# Words after the name of a person.
AFTER = re.compile(r"[\"'»”)]?,? ?(?:and i|and me|said|says|told|tells|will|would|wants|wanted|has|had|is my|was my|wrote|writes|asked|asks|called|works|worked|lives|lived|can|could|helped|gave|sent|thinks|knows|agreed|signed|joined|left|paid|picked|who|from accounting|sagte|sagt|hat|wird|kann|wohnt|arbeitet|schrieb|half|a dit|dit|m'a|a écrit|habite|travaille|viendra|dijo|dice|vive|trabaja|me ha|escribió|disse|dice|ha detto|abita|lavora|mora|trabalha)\b", re.I)

#: Another datum beside a name, on the next line or after a mark.
CONTACT = re.compile(r"\s?[\n,;|/<(\t-]\s*(?:\+?\d[\d ()-]{5}|[\w.+-]+ ?(?:@|[\[(]at[\])]))", re.I)
CONTACT_BEFORE = re.compile(r"(?:\d|@[\w.-]+)\s?[\n,;|/\t]\s*$")

_WIDE = {0xFF01 + k: 0x21 + k for k in range(94)} | {0x3000: 0x20, 0xA0: 0x20, 0x202F: 0x20, 0x2007: 0x20, 0x2009: 0x20, 0x2011: 0x2D, 0x2010: 0x2D, 0x2013: 0x2D}
_ANY_WIDE = re.compile("[" + "".join(map(chr, _WIDE)).replace("\uff3d", "").replace("\uff3c", "") + "]")


def plain(text: str) -> str:
    """The text with narrow characters, one for one."""
    return text.translate(_WIDE) if not text.isascii() and _ANY_WIDE.search(text) else text


class Candidate(NamedTuple):
    begin: int
    end: int
    type: str
    features: tuple[str, ...]


class Lexicon(NamedTuple):
    """Words with a piece of their own in a public vocabulary: in lower case, and capitalised only."""

    ordinary: frozenset[str]
    proper: frozenset[str]

    def kind(self, word: str) -> str:
        low = word.lower().strip(".'’-")
        if low in COMMON and (len(low) > 1 or word.islower()) or word[:1].islower() and ELIDED.match(low):
            return "common"
        if len(low) < 2:
            return "letter"
        if low in self.ordinary:
            return "ordinary"
        return "proper" if low in self.proper else "rare"


@lru_cache(maxsize=2)
def lexicon(paths: tuple[str, ...] = VOCABULARIES) -> Lexicon:
    """Read from rank files; a fixed number of words, whatever the data."""
    lower, upper = set(), set()
    for path in paths:
        with open(path, "rb") as f:
            for line in f:
                piece = base64.b64decode(line.split()[0])
                if piece[:1] == b" " and len(piece) > 3:
                    try:
                        word = piece[1:].decode()
                    except UnicodeDecodeError:
                        continue
                    if word.isalpha():
                        (lower if word.islower() else upper if word.istitle() else set()).add(word.lower())
    return Lexicon(frozenset(lower - GIVEN - SURNAMES), frozenset(upper - lower))


_W = r"[^\W\d_]+"
EMAIL = re.compile(r"[\w+-]+(?:[.+][\w+-]+)*[ \t]?(?:@|\(at\)|\[at\]|\(@\)|\{at\}|<at>)[ \t]?[A-Za-z0-9-]+(?:(?:\.|[ \t]?(?:\(dot\)|\[dot\]|\{dot\}|\(\.\))[ \t]?)[A-Za-z0-9-]+)+", re.I)
NUMBER = re.compile(r"(?<![\w.,/#])(?:(?:\+|\(\+?)?\d(?:[\d .\-/()]|\d){3,26}\d)(?: ?(?:extension|ext|x|durchwahl|poste)\.? ?\d{1,5})?(?![\d\w])", re.I)
IDENT = re.compile(r"(?<![\w.,/#@-])(?=[A-Za-z\d])(?:[A-Z]{1,2}[ -]?)?\d(?:[ -]?\d){3,15}(?:[ -]?[A-Z](?:[ -]?\d{1,3})?)?(?![\w@])|(?<![\w.,/#@-])(?=\d{0,6}[A-Z])(?=(?:[A-Z]*\d){3})[A-Z0-9]{7,16}(?![\w@])|(?<![\w.,/#@-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w@])")
_TOWN = rf"(?:{_W}(?:[ -]{_W}){{0,2}})"
_TAIL_EN = rf"(?:,? (?:Apt|Apartment|Unit|Suite|Flat|#)\.? ?\w+)?(?:(?:,\s|\n)?(?:{_TOWN}(?:,? [A-Z]{{2}} ?\d{{5}}(?:-\d{{4}})?| [A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}}))|,\s{_W})?"
ADDRESS = {
    "street": re.compile(rf"(?:(?:Flat|Apt|Apartment|Unit|Suite) \w+, (?:{_W} (?:Court|House|Building|Tower), )?)?(?<![\w.,/-])\d{{1,5}}[A-Za-z]? (?:[NSEW]\.? )?{_W}(?: {_W})?,? {STREET}(?![\w]){_TAIL_EN}", re.I),
    "box": re.compile(rf"\b(?:P\.? ?O\.? ?Box|Post Office Box|Postfach|Apartado(?: de correos)?|B\.?P\.?|Casella postale|Caixa postal|Postbus) \d{{1,6}}(?:, (?:\d{{4,5}} )?{_TOWN})?", re.I),
    "rue": re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|av\.|place|boulevard|bd|allée|chemin|impasse|quai|cours|passage|square)\b(?: (?:de la|de l'|des|du|de|d'))? ?{_W}(?:[ -]{_W})?(?:, (?:\d{{5}} )?{_W})?", re.I),
    "strasse": re.compile(rf"(?:\b{_W}(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|straat|laan|plein|gatan|vägen|gade|vej)|\b(?:Am|An der|Im|Zum|Zur|Auf dem) {_W}) \d{{1,4}} ?[a-z]?(?![\w])(?:, (?:\d{{4,5}} ?(?:[A-Z]{{2}} )?)?{_W})?", re.I),
    "calle": re.compile(rf"(?<![^\W_])(?:C/|Calle|Avda\.?|Avenida|Plaza|Paseo|Camino|Rua|Travessa|Praça|Via|Viale|Piazza|Corso|Largo|ul\.|al\.|os\.|pl\.|ulica|aleja|ул\.|улица|проспект|пр\.) ?(?:de la |de los |de las |del |de |da |do |dos |di |della |dei )?{_W}(?: {_W})?,? ?(?:nº|n°|núm\.?|no\.|n\.|д\.)? ?\d{{1,4}}(?:/\d{{1,4}})?[a-z]?(?![\w])(?:, (?:\d{{1,2}}º ?[A-Z]|кв\. ?\d{{1,4}}|int\. ?\d{{1,3}}|apto?\.? ?\d{{1,4}})\b)?(?:, (?:\d{{2}}-?\d{{3}} |\d{{4}}-\d{{3}} )?{_W})?", re.I),
    "cjk": re.compile(r"[\u3400-\u9fffぁ-んァ-ヶー]{2,16}\s?\d{1,5}(?:号|番地|番|丁目\s?\d{1,3}(?:[-−番]\d{1,4}){0,2}号?)(?:\d{1,4}(?:室|楼|栋|号))?"),
}
COMMON = frozenset(
    """the and for with that this about was not are but his her you your our their from into when which what who how why can could would should may might will we he she they i it
has had have is does did as at in on of to by or if then than so no yes an a my me be been do each every some any all there here now never ever also only just please thanks hello dear
es que la el los las una uno un por para como de del e il lo gli le per non ma che con sul sulla et les des du pas pour dans sur est une der die das dem den und ist nicht mit von zu im auf ein eine wie wenn aber
o os as um uma em no na mais se sie er wir ihr ich je tu il elle nous vous yo tú él nos sono eu ele ela è é à ai au aux ou où y da di do dos più plus moins pas sich aus bei nach über um vor noch nur auch sehr pero muy sin sobre entre si ci vi mi ti lo ne cui chi""".split()
)
# What any match of an address grammar holds beside a number of the (lower-case) text; each test is wider than its
# grammar, so an address is never missed, and only the surroundings of numbers are read.
_AFTER_STREET = re.compile(rf"[a-z]? (?:[nsew]\.? )?{_W}(?: {_W})?,? {STREET}(?![\w])")
_AFTER_RUE = re.compile(r"(?: ?(?:bis|ter))?,? (?:rue|avenue|av\.|place|boulevard|bd|allée|chemin|impasse|quai|cours|passage|square)\b")
_ROAD_END = ("straße ", "strasse ", "str. ", "weg ", "gasse ", "allee ", "platz ", "ring ", "damm ", "ufer ", "straat ", "laan ", "plein ", "gatan ", "vägen ", "gade ", "vej ")
_BOX_END = ("box ", "postfach ", "apartado ", "correos ", "p ", "p. ", "postale ", "postal ", "postbus ")
_AT_THE = re.compile(r"(?:am|an der|im|zum|zur|auf dem) [^\W\d_]+ $")
_CALLE = re.compile(r"c/|calle|avda|avenida|plaza|paseo|camino|rua|travessa|praça|via|piazza|corso|largo|ul\.|al\.|os\.|pl\.|ulica|aleja|ул|проспект|пр\.")
_CJK = re.compile(r"[\u3400-\u9fffぁ-んァ-ヶー]\s?\d")
_NUMBERS = re.compile(r"\d+")


def roads(low: str) -> set[str]:
    """The address grammars that may match a text, given in lower case."""
    found = {"calle"} if _CALLE.search(low) else set()
    if not low.isascii() and _CJK.search(low):
        found.add("cjk")
    for m in _NUMBERS.finditer(low):
        b, e = m.span()
        if b and low[b - 1] == " ":
            if low.endswith(_ROAD_END, 0, b) or _AT_THE.search(low, max(0, b - 60), b):
                found.add("strasse")
            if low.endswith(_BOX_END, 0, b):
                found.add("box")
        if _AFTER_STREET.match(low, e):
            found.add("street")
        if _AFTER_RUE.match(low, e):
            found.add("rue")
    return found


def lower(text: str) -> str:
    """The text in lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"\d(?:\D*\d){3}")
_WORD = re.compile(_W)
_CAP = r"[A-Z\u00c0-\u00d6\u00d8-\u00de\u0100-\u017f\u0410-\u042f]"
_ATOM = rf"{_W}(?:['’-]{_W})*"
_CAPPED = rf"{_CAP}[^\W\d_]*(?:['’-]{_W})*"
#: Runs of capitalised words, with particles and initials between them.
RUN = re.compile(rf"(?<![\w@+/-])(?<!\w\.){_CAPPED}(?:(?:\.? |, )(?:{PARTICLES} ){{0,1}}{_CAPPED})+(?![\w@])")
_TITLE = r"(?:(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\b\.?|M\.)"
TITLED = re.compile(rf"(?<![\w@.+'’-]){_TITLE} (?:[A-Z]\. )?(?:{PARTICLES} )?{_ATOM}(?: (?:[A-Z]\. )?{_ATOM})?", re.I)
#: Words in any case after a listed given name or a phrase that leads to a name.
PAIR = re.compile(rf"({_ATOM}) (?:[A-Za-z]\. )?(?:{PARTICLES} )?({_ATOM})(?![\w@])(?! ?(?:@|\(at|\[at))", re.I)
TURNED = re.compile(rf"(?<![\w@.+-])({_ATOM}), ({_ATOM})(?: [A-Z]\.)?(?![\w@])", re.I)
LEADS = re.compile(r"(?:(name is|name:|i am|i'm|this is|signed,?|dear|m'appelle|je suis|ich heiße|ich bin|me llamo|soy|mi chiamo|me chamo|behalf of|cc:?|nom ?:|nombre:|nome:)|neighbou?r|colleague|friend|landlord|teacher|doctor|client|patient|kolleg(?:e|in)|nachbar(?:in)?|collègue|voisine?|vecin[oa]|colega|collega)\s+(?=\w)")
#: A word of each of these phrases.
_LEAD_WORDS = frozenset("name am m this signed dear appelle suis heiße bin llamo soy chiamo chamo behalf cc c nom nombre nome neighbour neighbor colleague friend landlord teacher doctor client patient kollege kollegin nachbar nachbarin collègue voisin voisine vecino vecina colega collega".split())
#: Ends of surnames that few other words have; a word before one may be a given name in any case.
SUR_END = re.compile(r"(?:sky|ska|ski|czyk|wicz|enko|sson|dottir|mann|berg|stein|burg|bach|field|wood|worth|brook|ton|quist|ström|opoulos|oğlu|etti|ucci|oux|ović)(?![\w])")
_BEFORE = re.compile(rf"(?<![\w@.+-])({_ATOM}) (?:[A-Za-z]\. )?((?:[^\W\d_]+['’-])*[^\W\d_]*)$")
_ITEM = re.compile(rf"{_ATOM}\.?")


# Words cut before an apostrophe.
ELIDED = re.compile(r"(?:[ldjncsmt]|qu|quelqu|jusqu|lorsqu|puisqu|presqu|un|dell|nell|all|dall|sull|quell|quest|c)['’]")


def fold(word: str) -> str:
    """A word without case and accents, as the lists of names hold it."""
    word = word.casefold()
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


GIVEN, SURNAMES, TITLES = (frozenset(map(fold, x)) | x for x in (GIVEN, SURNAMES, TITLES))
_KNOWN = GIVEN | TITLES | SURNAMES


def _luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _weighted(digits: str, weights: tuple[int, ...], mod: int) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights, strict=False)) % mod


def checks(text: str) -> list[str]:
    """Public check-digit rules that a number meets."""
    s = re.sub(r"[ .\-/]", "", text).upper()
    found = []
    if s.isdigit():
        n = len(s)
        if 15 <= n <= 19 and _luhn(s):
            found.append("luhn")
        if n == 9 and _luhn(s):
            found.append("luhn9")
        if n == 11:
            if (10 - _weighted(s, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3), 10)) % 10 == int(s[10]):
                found.append("pesel")
            d1 = _weighted(s, tuple(range(10, 1, -1)), 11)
            d2 = _weighted(s, tuple(range(11, 1, -1)), 11)
            if int(s[9]) == (0 if d1 < 2 else 11 - d1) and int(s[10]) == (0 if d2 < 2 else 11 - d2):
                found.append("cpf")
        if n == 15 and int(s[13:]) == 97 - int(s[:13]) % 97:
            found.append("nir")
    elif re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", s):
        number = s[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")
        if "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == s[-1]:
            found.append("dni")
    elif re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}", s):
        if int("".join(str(int(ch, 36)) for ch in s[4:] + s[:4])) % 97 == 1:
            found.append("iban")
    elif re.fullmatch(r"[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z]", s):
        found.append("fiscal")
    return found


def _shape(number: str) -> str:
    return "-".join(str(len(x)) for x in re.findall(r"\d+", number))


def _around(text: str, begin: int, end: int) -> list[str]:
    line = text.rfind("\n", 0, begin) + 1
    left = text[max(line, begin - 34) : begin]
    found = [f"cue={k}" for k, r in LEFT.items() if left and r.search(left)]
    stop = text.find("\n", end)
    rest = text[end : stop if stop >= 0 else len(text)]
    if not left.strip() and not rest.strip(" ,."):
        found.append("own_line")
    if re.search(r"[|;\t]\s*$", left) or re.match(r"\s*[|;\t]", rest):
        found.append("in_list")
    if left[-1:] in "#:x+*/=":
        found.append("glued_left" if left else "line_start")
    if rest[:1] and rest[:1] in ":+*/=%":
        found.append("glued_right")
    if re.match(r" ?[+*/=^<>%€$£] ?\d?|\s(?:kg|km|m|cm|mm|gb|mb|ms|euros?|dollars?|percent|people|points|rows|times)\b", rest, re.I) or re.search(r"[+*/=^<>€$£] ?$", left):
        found.append("quantity")
    return found


def _case(word: str) -> str:
    return "upper" if word.isupper() and len(word) > 1 else "title" if word[:1].isupper() else "lower"


def _surname(word: str, words: Lexicon) -> str:
    last = [p for p in re.split(r"[-'’]", word.lower()) if p][-1:]
    last = last[0] if last else ""
    if fold(last) in SURNAMES:
        return "listed"
    kind = words.kind(last)
    if kind in ("common", "letter", "ordinary"):
        return kind
    return f"{kind}_end" if len(last) >= 5 and ENDINGS.search(last) else kind


def _name(text: str, begin: int, end: int, form: str, words: Lexicon) -> Candidate | None:
    """A candidate name with its features; none where the span begins or ends with a function word."""
    span = text[begin:end]
    parts = [m.group() for m in _ITEM.finditer(span)]
    if form == "title":
        bare = [p for p in parts[1:] if len(p.rstrip(".")) > 1]
        if not bare or words.kind(bare[-1]) == "common":
            return None
        features = ["title", f"title_sur={_surname(bare[-1], words)}", f"case={_case(parts[0])}-{_case(bare[-1])}", f"n={len(bare)}"]
        if len(bare) > 1:
            features.append(f"mid={words.kind(bare[0]) if fold(bare[0]) not in GIVEN else 'given'}-{_case(bare[0])}")
    else:
        if form == "turned":
            parts = [*parts[1:], parts[0]] if len(parts[-1].rstrip(".")) > 1 else [parts[1], parts[0]]
        first, last = parts[0].rstrip("."), parts[-1].rstrip(".")
        a, b = words.kind(first), _surname(last, words)
        if a == "common" or b == "common" or b == "letter" or first.lower() in TITLES:
            return None
        if fold(first) in GIVEN:
            a = "given"
        elif fold(first) in SURNAMES:
            a = "surname"
        if any(words.kind(p) == "common" and p.lower() not in _PARTS for p in parts[1:-1]):
            return None
        inner = [p for p in parts[1:-1] if p[:1].isupper() and len(p.rstrip(".")) > 1]
        features = [form, f"first={a}", f"last={b}", f"pair={a}-{b}", f"case={_case(first)}-{_case(last)}", f"n={2 + len(inner)}"]
        features += [f"inner={'given' if fold(p) in GIVEN else _surname(p, words)}" for p in inner]
        if _case(first) == "lower":
            features.append(f"lower={a}-{b}")
        if any(len(p.rstrip(".")) == 1 for p in parts[1:-1]):
            features.append("initial")
        if fold(last) in GIVEN:
            features.append("last_is_given")
    before, after = text[max(0, begin - 24) : begin], text[end : end + 26]
    start = not before.strip() or before.rstrip()[-1:] in ".!?:\n•*-" or "\n" in before[len(before.rstrip()) :]
    features.append(f"start={features[1]}" if start else "inside")
    if m := re.search(r"([^\W\d_]+)\.?,? $", before):
        features.append(f"before={'cap' if m.group(1)[0].isupper() else words.kind(m.group(1))}")
    if re.match(rf" {_CAP}", after):
        features.append("goes_on")
    elif m := re.match(r" ([^\W\d_]+)", after):
        features.append(f"after={words.kind(m.group(1))}")
    if AFTER.match(after):
        features.append("acts")
    if CONTACT.match(after) or CONTACT_BEFORE.search(before):
        features.append("contact")
    return Candidate(begin, end, "name", tuple(f"name|{f}" for f in ("bias", *features, *_around(text, begin, end))))


def _names(text: str, low: str, words: Lexicon) -> Iterator[Candidate]:
    spans: dict[tuple[int, int], str] = {}
    found = _WORD.findall(low)
    known = not _KNOWN.isdisjoint(found) or not low.isascii() and not _KNOWN.isdisjoint(fold(w) for w in found if not w.isascii())
    for m in RUN.finditer(text):
        items = [(m.start() + i.start(), m.start() + i.end(), i.group()) for i in _ITEM.finditer(m.group())]
        capped = [k for k, i in enumerate(items) if i[2][0].isupper()]
        for n, k in enumerate(capped):
            if len(items[k][2].rstrip(".")) == 1:
                continue
            for j in capped[n + 1 : n + 4]:
                b, e = items[k][0], items[j][1] - items[j][2].endswith(".")
                commas = text.count(",", b, e)
                if len(items[j][2].rstrip(".")) == 1 or any(i[2].endswith(".") and len(i[2]) > 2 for i in items[k:j]):  # a sentence ends inside
                    continue
                if not commas:
                    spans.setdefault((b, e), "plain")
                elif commas == 1 and j == k + 1 and text[items[k][1] : items[j][0]] == ", ":
                    spans.setdefault((b, e), "turned")
    if known:
        at = 0
        while m := TITLED.search(text, at):
            spans[m.span()] = "title"
            one = re.match(rf"{_TITLE} (?:[A-Z]\. )?(?:{PARTICLES} )?{_ATOM}", m.group(), re.I)
            spans[m.start(), m.start() + one.end()] = "title"
            at = m.start() + one.end() - 1 if one.end() > 1 else m.end()
        for m in _WORD.finditer(text):
            if fold(m.group()) in GIVEN:
                if (p := PAIR.match(text, m.start())) and (m.start() == 0 or text[m.start() - 1] not in "@.+-"):
                    spans.setdefault(p.span(), "plain")
                    q = re.compile(rf" {_ATOM}(?![\w@])").match(text, p.end())
                    if q:
                        spans.setdefault((p.start(), q.end()), "plain")
        for m in TURNED.finditer(text):
            if fold(m.group(2)) in GIVEN:
                spans.setdefault(m.span(), "turned")
    for m in SUR_END.finditer(low):
        at = max(text.rfind("\n", 0, m.start()) + 1, m.start() - 48)
        if (p := _BEFORE.search(text, at, m.start())) and p.group(2) and p.group(2)[0].islower() and words.kind(p.group(1)) in ("rare", "proper") and words.kind(text[p.start(2) : m.end()]) in ("rare", "proper"):
            spans.setdefault((p.start(), m.end()), "plain")
    if known:
        for m in _WORD.finditer(text):
            if m.group()[0].islower() and fold(m.group()) in SURNAMES:
                if (p := _BEFORE.search(text, max(0, m.start() - 40), m.end())) and words.kind(p.group(1)) in ("rare", "proper") and p.end() == m.end():
                    spans.setdefault((p.start(), m.end()), "plain")
    for m in LEADS.finditer(low) if not _LEAD_WORDS.isdisjoint(found) else ():
        if m.start() and low[m.start() - 1].isalnum():
            continue
        if (p := PAIR.match(text, m.end())) and words.kind(p.group(1)) in ("rare", "proper") or p and m.group(1):
            spans.setdefault(p.span(), "plain")
    for (b, e), form in spans.items():
        if c := _name(text, b, e, form, words):
            yield c


def candidates(text: str, words: Lexicon, kinds: str = "endr") -> list[Candidate]:
    """All candidate segments of a (narrow) text, each with the features of its whole span.
    ``kinds`` names the grammars to try: e-mail, name, digits, road."""
    out: list[Candidate] = []

    def propose(b: int, e: int, kind: str, features: list[str]) -> None:
        out.append(Candidate(b, e, kind, tuple(f"{kind}|{f}" for f in ("bias", *features, *_around(text, b, e)))))

    if "e" in kinds:
        for m in EMAIL.finditer(text):
            propose(*m.span(), "email", ["dots" if "dot" in m.group().lower() else "plain"])
    for m in NUMBER.finditer(text) if "d" in kinds else ():
        b, e = m.span()
        while text[e - 1] in " .-/(":
            e -= 1
        s = text[b:e]
        digits = sum(c.isdigit() for c in s.split("ext")[0])
        if digits < 7:
            continue
        groups = len(re.findall(r"\d+", s))
        features = [f"shape={_shape(s)}", f"digits={min(digits, 16)}", f"groups={min(groups, 6)}", "plus" if "+" in s or s.startswith("00") else "zero" if s.lstrip("(").startswith("0") else "other", "dots" if s.count(".") > 1 else "dot" if "." in s else "no_dot", *checks(s)]
        if groups == 1:
            features.append("one_group")
        if re.match(r"(?:19|20)\d\d[-./ ]", s):
            features.append("year")
        if "/" in s or "(" in s:
            features.append("area")
        propose(b, e, "phone", features)
        propose(b, e, "id_number", features)
    for m in IDENT.finditer(text) if "d" in kinds else ():
        b, e = m.span()
        s = m.group()
        if s[-2:] in (" I", " A") and s[0].isdigit() and re.match(r" [a-z]", text[e : e + 2]):  # the next sentence
            s, e = s[:-2], e - 2
        if sum(c.isdigit() for c in s) >= (4 if len(s) >= 8 else 5) and not s.isdigit() and any(c.isalpha() for c in s):
            propose(b, e, "id_number", ["letters", f"shape={_shape(s)}", f"head={len(re.match(r'[A-Z]*', s).group())}", "tail" if s[-1].isalpha() else "no_tail", f"size={min(16, sum(c.isalnum() for c in s))}", "blanks" if " " in s else "hyphens" if "-" in s else "joined", *checks(s)])
    low = lower(text)
    may = roads(low) if "r" in kinds else set()
    for kind, regex in ADDRESS.items() if may else ():
        for m in regex.finditer(text) if kind in may else ():
            s = m.group()
            propose(*m.span(), "address", [f"form={kind}", "town" if "," in s or "\n" in s else "no_town", "capitals" if any(w[0].isupper() for w in _WORD.findall(s)[:3]) else "small"])
    if "n" in kinds:
        out.extend(_names(text, low, words))
    return out


def decode(found: list[Candidate], weights: dict[str, float]) -> list[Candidate]:
    """The best set of segments that do not overlap; text outside any segment scores 0."""
    scored = [(sum(weights.get(f, 0.0) for f in c.features), c) for c in found]
    scored = sorted(((s, c) for s, c in scored if s > 0), key=lambda x: (x[1].end, x[1].begin))
    best: list[tuple[float, int, tuple]] = [(0.0, 0, ())]  # score, end, chain of segments
    for s, c in scored:
        k = len(best) - 1
        while best[k][1] > c.begin:
            k -= 1
        total = best[k][0] + s
        if total > best[-1][0]:
            best.append((total, c.end, (best[k][2], c)))
    chain, out = best[-1][2], []
    while chain:
        chain, c = chain
        out.append(c)
    return out[::-1]


# --- training on generated lines ---------------------------------------------------------


def _forward(found: list[Candidate], score: list[float]) -> tuple[float, list[float]]:
    """log Z of the lattice and the marginal of each candidate."""
    points = sorted({0} | {c.end for c in found} | {c.begin for c in found})
    at = {p: k for k, p in enumerate(points)}
    n = len(points)
    alpha, beta = [0.0] * n, [0.0] * n
    ends, begins = defaultdict(list), defaultdict(list)
    for k, c in enumerate(found):
        ends[at[c.end]].append(k)
        begins[at[c.begin]].append(k)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for p in range(1, n):
        alpha[p] = alpha[p - 1]
        for k in ends[p]:
            alpha[p] = add(alpha[p], alpha[at[found[k].begin]] + score[k])
    for p in range(n - 2, -1, -1):
        beta[p] = beta[p + 1]
        for k in begins[p]:
            beta[p] = add(beta[p], beta[at[found[k].end]] + score[k])
    return alpha[-1], [math.exp(min(0.0, alpha[at[c.begin]] + s + beta[at[c.end]] - alpha[-1])) for c, s in zip(found, score, strict=True)]


@lru_cache(maxsize=4)
def train(lines: int = 6000, epochs: int = 6, seed: int = 7, rate: float = 0.2, decay: float = 1e-4, vocabularies: tuple[str, ...] = VOCABULARIES) -> dict[str, float]:
    """Weights by stochastic gradient ascent of the conditional likelihood."""
    from palaver.llm.pii_lines import line

    rng, words = random.Random(seed), lexicon(vocabularies)
    data = []
    for _ in range(lines):
        text, true = line(rng)
        text = plain(text)
        found = candidates(text, words)
        gold = {(b, e, k) for b, e, k in true}
        if not found:
            continue
        hit = [(c.begin, c.end, c.type) in gold for c in found]
        # where no proposal is exactly the segment, the one nearest to it stands for it
        for b, e, k in gold:
            if not any(h and c.type == k and c.begin == b for h, c in zip(hit, found, strict=True)):
                near = [j for j, c in enumerate(found) if c.type == k and c.begin < e and c.end > b]
                if near:
                    hit[max(near, key=lambda j: min(found[j].end, e) - max(found[j].begin, b) - 0.5 * abs(found[j].end - found[j].begin - (e - b)))] = True
        data.append((found, hit))
    weights: dict[str, float] = defaultdict(float)
    for epoch in range(epochs):
        rng.shuffle(data)
        step = rate / (1 + epoch)
        for found, hit in data:
            score = [sum(weights[f] for f in c.features) for c in found]
            _, marginal = _forward(found, score)
            for c, h, p in zip(found, hit, marginal, strict=True):
                g = step * (h - p)
                if abs(g) > 1e-4:
                    for f in c.features:
                        weights[f] += g - step * decay * weights[f]
    return {f: round(w, 5) for f, w in weights.items() if abs(w) > 1e-3}


# --- over messages ---------------------------------------------------------------------


class Finder:
    """Finds the segments of messages; a grammar is tried unless the message can have no candidate of it."""

    def __init__(self, weights: dict[str, float], words: Lexicon) -> None:
        self.weights, self.words = weights, words

    def kinds(self, text: str) -> str:
        """The grammars that may find something in a text: an e-mail address holds an at sign, a
        number four digits, an address a digit. Names are always looked for."""
        low = text.lower()
        found = "e" if "@" in text or "(at)" in low or "[at]" in low or "{at}" in low or "<at>" in low else ""
        if _DIGIT.search(text):
            found += "r"
            if _DIGITS.search(text):
                found += "d"
        return found + "n"

    def find(self, text: str | None) -> list[Candidate]:
        if not text or text.isspace():
            return []
        text = plain(text)
        return decode(candidates(text, self.words, self.kinds(text)), self.weights)


MENTIONS = "array<struct<side:string,message_no:int,pii_type:string,pii_no:int,mention:string>>"


def find_in_messages(df: DataFrame, keep: list[str], sides: dict[str, str], replace: bool = False, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """One row per row of ``df``: ``keep`` and the array ``mentions`` of (side, message_no,
    pii_type, pii_no, mention); with ``replace`` also each conversation with the mentions
    replaced by typed placeholders and all other characters as they were.

    ``sides`` maps a name to the column of messages. Null conversations, messages and
    contents have no mentions and stay null; equal messages of the two sides are read once.
    Messages are read whole. The weights are fitted once on the driver and are a few KB; the
    vocabulary files, of a fixed size, are sent to the executors once.
    """
    weights = train(vocabularies=vocabularies)
    for path in vocabularies:
        df.sparkSession.sparkContext.addFile(path)
    files = [os.path.basename(path) for path in vocabularies]
    names, cols = list(sides), list(sides.values())
    keep = [c for c in keep if c not in cols]
    message = "array<struct<role:string,content:string>>"
    held = df.select(*keep, *[F.transform(c, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias(c) for c in cols])
    schema = held.select(*keep, F.lit(None).cast(MENTIONS).alias("mentions"), *([F.lit(None).cast(message).alias(c) for c in cols] if replace else [])).schema
    mention_type = pa.list_(pa.struct([("side", pa.string()), ("message_no", pa.int32()), ("pii_type", pa.string()), ("pii_no", pa.int32()), ("mention", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(weights, lexicon(tuple(SparkFiles.get(f) for f in files)))
        for b in batches:
            rows: list[list[dict]] = [[] for _ in range(b.num_rows)]
            seen: dict[str, list[Candidate]] = {}
            new_columns = []
            for k, side in enumerate(names):
                col = b.column(len(keep) + k)
                offsets = col.offsets.to_pylist()
                texts = col.values.field(1).to_pylist()
                changed = list(texts) if replace else []
                for row in range(b.num_rows):
                    for at in range(offsets[row], offsets[row + 1]):
                        t = texts[at]
                        if not t:
                            continue
                        found = seen.get(t)
                        if found is None:
                            found = seen[t] = finder.find(t)
                        if not found:
                            continue
                        number: dict[str, int] = {}
                        for c in found:
                            number[c.type] = number.get(c.type, 0) + 1
                            rows[row].append({"side": side, "message_no": at - offsets[row], "pii_type": c.type, "pii_no": number[c.type], "mention": t[c.begin : c.end]})
                        if replace:
                            out, last = [], 0
                            for c in found:
                                out += [t[last : c.begin], PLACEHOLDER[c.type]]
                                last = c.end
                            changed[at] = "".join([*out, t[last:]])
                if replace:
                    values = pa.StructArray.from_arrays([col.values.field(0), pa.array(changed, pa.string())], ["role", "content"])
                    new_columns.append(pa.ListArray.from_arrays(col.offsets, values, mask=col.is_null() if col.null_count else None))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(rows, mention_type), *new_columns], names=[*keep, "mentions", *(cols if replace else [])])

    return held.mapInArrow(run, schema)

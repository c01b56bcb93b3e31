"""Generated lines for the personal-data field: public forms of data in invented carrier lines.

Numbers follow public formats, with their check digits where they have any; half of them
are damaged, as invented numbers are. Names mix listed given names with invented ones, and
listed surnames with invented ones. Half of the lines hold no data of a person but what
looks like it: versions, references, sums, methods, places, teams, products, titles.
"""

from __future__ import annotations

import random

Segment = tuple[int, int, str]


def digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def syllables(rng: random.Random, n: int) -> str:
    onset, vowel, coda = ("b br d dr f g gr h j k kl l m n p pr r s st t tr v w z".split(), "a e i o u a e o".split(), ["", "", "", "n", "r", "l", "s", "t", "m"])
    return "".join(rng.choice(onset) + rng.choice(vowel) + rng.choice(coda) for _ in range(n)).capitalize()


# Given names and surnames used in training lines, by country.
PEOPLE = {
    "en": ("james mary john linda robert susan david karen thomas emily oliver george rachel laura simon hannah".split(), "smith jones taylor brown walker hughes edwards thompson wright harris clarke".split(), "wood ford ley ton worth well field man son".split()),
    "de": ("hans klaus stefan andreas sabine monika heike ursula lena jonas katharina wolfgang".split(), "müller schmidt schneider fischer weber meyer wagner becker hoffmann koch".split(), "mann berg stein bach er burg".split()),
    "fr": ("pierre jean michel claire camille antoine nathalie philippe isabelle julien hugo".split(), "martin bernard dubois durand moreau laurent simon".split(), "aux eau ard ier oux et".split()),
    "es": ("juan carlos miguel pablo carmen marta javier lucía antonio josé".split(), "garcía fernández gonzález lópez martínez sánchez pérez gómez".split(), "ez es ano era osa".split()),
    "it": ("giovanni luca marco paolo giulia francesca chiara alessandro elena".split(), "rossi russo ferrari esposito bianchi romano".split(), "ini etti elli ucci ano".split()),
    "pt": ("joão pedro ana inês tiago beatriz rui".split(), "silva santos ferreira pereira oliveira costa".split(), "eira ões inho ares".split()),
    "xx": ("ivan olga natalia igor mehmet ayşe ahmed fatima omar hassan raj priya amit wei hiroshi yuki minh chidi amara boris lars astrid".split(), "ivanov petrov kim nguyen tran singh patel sharma khan yılmaz".split(), "ov ova ski ić sen ström oğlu enko wala".split()),
}
TITLED = {"en": "Mr Mrs Ms Miss Dr Prof. Mr. Mrs. Dr.".split(), "de": "Herr Frau Dr. Prof.".split(), "fr": "M. Mme Mlle Monsieur Madame".split(), "es": "Sr. Sra. Don Doña Dr. Dra.".split(), "it": "Sig. Signora Dott. Signor".split(), "pt": "Sr. Sra. Dra. Dona".split(), "xx": "Mr Ms Dr. Mrs Prof.".split()}


def name(rng: random.Random, country: str) -> str:
    given_list, sur_list, ends = PEOPLE[country]
    given = lambda: rng.choice(given_list).title() if rng.random() < 0.6 else syllables(rng, rng.choice((2, 2, 3)))
    sur = lambda: rng.choice(sur_list).title() if rng.random() < 0.3 else syllables(rng, rng.choice((1, 2, 2))) + rng.choice([*ends, ""])
    g, s = given(), sur()
    form = rng.random()
    if form < 0.55:
        out = f"{g} {s}"
    elif form < 0.63:
        out = f"{g} {rng.choice('ABCDEFGHJKLMPRSTW')}. {s}"
    elif form < 0.71:
        out = f"{s}, {g}"
    elif form < 0.77:
        out = f"{g} {s}-{sur()}" if rng.random() < 0.6 else f"{g}-{given()} {s}"
    elif form < 0.83:
        out = rng.choice([f"{g} {given()} {s}", f"{g} {s} {sur()}", f"{s} {g} {given()}" if country == "xx" else f"{g} {given()} {s}"])
    elif form < 0.87:
        out = f"{g} {rng.choice({'de': ['von'], 'fr': ['de', 'du'], 'es': ['de la', 'del'], 'it': ['di', 'de'], 'pt': ['da', 'dos']}.get(country, ['van', 'de', 'al']))} {s}"
    else:
        out = f"{rng.choice(TITLED[country])} {s}" if rng.random() < 0.7 else f"{rng.choice(TITLED[country])} {g} {s}"
    return rng.choice([str, str, str, str, str.upper, str.lower])(out)


def email(rng: random.Random, country: str) -> str:
    a, b = (syllables(rng, rng.choice((1, 2))).lower() for _ in range(2))
    local = rng.choice([f"{a}.{b}", f"{a}_{b}", f"{a[0]}{b}", f"{a}{digits(rng, 2)}", f"{a}-{b}", f"{b}+{a}", a])
    host = rng.choice([f"{syllables(rng, 2).lower()}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io'])}", "example.net", "example.com", "mail.example.org", "inbox.test", "uni.example"])
    out = local + rng.choice(["@"] * 6 + [" @ ", " (at) ", "[at]", "(at)", " [at] "]) + host
    if "at" in out[len(local) : len(local) + 5] and rng.random() < 0.6:
        head, tail = out[: len(local) + 5], out[len(local) + 5 :]
        out = head + tail.replace(".", rng.choice([" (dot) ", "[dot]", " [dot] "]))
    return rng.choice([str, str, str, str.upper, str.title])(out)


def phone(rng: random.Random, country: str) -> str:
    d = lambda n: digits(rng, n)
    z = rng.choice("23456789")
    forms = {
        "en": [f"+44 {z}{d(3)} {d(6)}", f"0{z}{d(3)} {d(6)}", f"0{z}0 {d(4)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"+1 {z}{d(2)} {d(3)} {d(4)}", f"({z}{d(2)}) {d(3)}-{d(4)}", f"{z}{d(2)}-{d(3)}-{d(4)}", f"{z}{d(2)}.{d(3)}.{d(4)}", f"{d(3)}-{d(4)}", f"1-{z}{d(2)}-{d(3)}-{d(4)}", f"1-800-{d(3)}-{d(4)} ext. {d(3)}", f"+1-{z}{d(2)}-{d(3)}-{d(4)}", f"0044{z}{d(9)}", f"({z}{d(2)}) {d(3)} {d(4)} x{d(2)}", f"+1{z}{d(9)}"],
        "de": [f"+49 {z}{d(2)} {d(7)}", f"+49 (0){z}{d(1)} {d(8)}", f"0{z}{d(2)}/{d(7)}", f"0{z}{d(1)} {d(5)} {d(3)}", f"+49-{z}{d(1)}-{d(8)}", f"01{d(2)} {d(7)}", f"0{z}{d(3)}-{d(5)}"],
        "fr": [f"0{z} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{z}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+33 {z} {d(2)} {d(2)} {d(2)} {d(2)}", f"0033{z}{d(8)}", f"0{z}{d(8)}", f"0{z}-{d(2)}-{d(2)}-{d(2)}-{d(2)}"],
        "es": [f"6{d(2)} {d(3)} {d(3)}", f"9{d(2)} {d(2)} {d(2)} {d(2)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"0034 9{d(2)} {d(3)} {d(3)}", f"6{d(8)}", f"0034-9{d(2)}-{d(3)}-{d(3)}"],
        "it": [f"+39 3{d(2)} {d(7)}", f"3{d(2)} {d(3)} {d(4)}", f"06 {d(4)} {d(4)}", f"+39 02 {d(4)} {d(4)}"],
        "pt": [f"9{d(2)} {d(3)} {d(3)}", f"+351 9{d(2)} {d(3)} {d(3)}", f"({d(2)}) 9{d(4)}-{d(4)}", f"+55 {d(2)} 9{d(4)}-{d(4)}"],
        "xx": [f"+7 ({z}{d(2)}) {d(3)}-{d(2)}-{d(2)}", f"8 {z}{d(2)} {d(3)} {d(2)} {d(2)}", f"+91 {d(5)} {d(5)}", f"+86 1{d(2)} {d(4)} {d(4)}", f"+81-{d(2)}-{d(4)}-{d(4)}", f"+90 5{d(2)} {d(3)} {d(2)} {d(2)}", f"+46 70 {d(3)} {d(2)} {d(2)}", f"+971 5{d(1)} {d(3)} {d(4)}"],
    }
    return rng.choice(forms[country])


def _luhn_tail(s: str) -> str:
    total = 0
    for k, ch in enumerate(reversed(s)):
        n = int(ch) * (2 - k % 2)
        total += n - 9 * (n > 9)
    return s + str(-total % 10)


def ident(rng: random.Random, country: str) -> str:
    d = lambda n: digits(rng, n)
    u = lambda n: "".join(rng.choice("ABCEGHJKLMNPRSTWXYZ") for _ in range(n))
    ymd = f"{rng.randint(30, 99)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
    if country == "es":
        n = d(8)
        letter = "TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23] if rng.random() < 0.5 else u(1)
        return rng.choice([n + letter, f"{n}-{letter}", f"{n} {letter}", f"{n[:2]}.{n[2:5]}.{n[5:]}-{letter}", f"{rng.choice('XYZ')}{d(7)}{u(1)}", f"{rng.choice('XYZ')}-{d(7)}-{u(1)}", f"{u(3)}{d(6)}"])
    if country == "fr":
        n = f"{rng.choice('12')}{d(2)}{rng.randint(1, 12):02d}{d(2)}{d(6)}"
        key = f"{97 - int(n) % 97:02d}" if rng.random() < 0.5 else d(2)
        return rng.choice([n + key, f"{n[0]} {n[1:3]} {n[3:5]} {n[5:7]} {n[7:10]} {n[10:]} {key}", f"{d(2)}{u(2)}{d(5)}", f"{n} {key}"])
    if country == "de":
        return rng.choice([f"{u(1)}{d(2)}{u(1)}{d(2)}{u(1)}{d(2)}", f"{u(2)}{d(1)}{u(3)}{d(2)}{u(1)}{d(1)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), f"{d(2)} {ymd} {u(1)} {d(3)}", f"{d(2)}{ymd}{u(1)}{d(3)}", f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"])
    if country == "it":
        return rng.choice([f"{u(6)}{d(2)}{rng.choice('ABCDEHLMPRST')}{d(2)}{u(1)}{d(3)}{u(1)}", f"{u(2)}{d(5)}{u(2)}", f"{u(2)}{d(7)}"])
    if country == "pt":
        return rng.choice([f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", d(9), f"{d(8)} {d(1)} {u(2)}{d(1)}"])
    if country == "xx":
        card = _luhn_tail("4" + d(14))
        return rng.choice([f"{ymd}-{d(4)}", f"{ymd}{d(5)}", f"{d(4)} {d(4)} {d(4)}", f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", card, f"{d(4)} {d(6)}", f"{u(1)}{d(8)}", f"{u(2)} {d(7)}"])
    return rng.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), f"{u(2)} {d(2)} {d(2)} {d(2)} {u(1)}", f"{u(2)}{d(6)}{u(1)}", f"{u(1)}{d(8)}", f"{u(2)}{d(7)}", f"{d(3)} {d(3)} {d(3)}", f"{u(5)}{d(6)}{u(2)}{d(1)}{u(2)}", f"{u(1)}{d(3)}-{d(4)}-{d(4)}"])


def address(rng: random.Random, country: str) -> str:
    n, d = rng.randint(1, 399), lambda k: digits(rng, k)
    p, town = (syllables(rng, 2) + rng.choice(["", "", "bury", "ton", "ham", "ville", "stadt"]) for _ in range(2))
    kind = rng.choice("Street Road Lane Avenue Drive Close Court Crescent Terrace Way Gardens".split())
    forms = {
        "en": [f"{n} {p} {kind}", f"{n} {p} {kind}, {town}", f"{n}{rng.choice('ABC')} {p} {kind}", f"{n} {p} St.", f"{n} {p} Blvd", f"{n} {p} {kind}, {town} {rng.choice(['LS', 'M', 'B', 'CF'])}{d(1)} {d(1)}AB", f"{n} {p} {kind}, {town}, {rng.choice(['OH', 'TX', 'ME'])} {d(5)}", f"{n} {p} {kind}\n{town}, {rng.choice(['IA', 'UT'])} {d(5)}", f"Flat {rng.randint(1, 40)}, {n} {p} {kind}", f"{n} {p} Ave, Apt {rng.randint(1, 30)}, {town}", f"PO Box {n}, {town}", f"P.O. Box {d(4)}", f"{n} North {p} {kind}", f"Flat {rng.randint(1, 40)}, {p} House, {n} {town} {kind}, {syllables(rng, 2)}"],
        "de": [f"{p}straße {n}", f"{p}str. {n}", f"{p}weg {n}{rng.choice(['', 'a'])}, {d(5)} {town}", f"Am {p} {n}", f"{p}platz {n}, {town}", f"{p}allee {n}, {d(5)} {town}", f"Postfach {d(4)}, {d(5)} {town}", f"An der {p} {n}"],
        "fr": [f"{n} rue de {p}", f"{n}, rue {p}", f"{n} avenue {p}, {d(5)} {town}", f"{n} bis rue du {p}, {d(5)} {town}", f"{n}, boulevard {p}, {town}", f"{n} chemin des {p}", f"BP {d(3)}, {d(5)} {town}", f"{n} allée {p}", f"{n}, impasse {p}"],
        "es": [f"Calle {p} {n}", f"C/ {p}, {n}", f"Avenida de {p} {n}, {d(5)} {town}", f"Plaza {p} {n}, {town}", f"C/ {p} nº {n}, {rng.randint(1, 9)}º {rng.choice('ABCD')}, {d(5)} {town}", f"Paseo del {p} {n}", f"Apartado {d(3)}, {town}"],
        "it": [f"Via {p} {n}", f"Viale {p} {n}, {d(5)} {town}", f"Piazza {p}, {n}", f"Corso {p} {n}, {town}"],
        "pt": [f"Rua {p} {n}", f"Rua da {p}, {n}, {town}", f"Avenida {p}, {n}", f"Travessa do {p} {n}"],
        "xx": [f"ul. {p} {n}", f"{n} {p} Road", f"{p}gatan {n}", f"улица {rng.choice(['Садовая', 'Лесная', 'Мира', 'Новая'])}, {n}", f"{rng.choice(['上海市南京东路', '北京市东长安街', '杭州市文三路', '成都市人民南路'])}{n}号", f"{rng.choice(['東京都港区芝公園', '大阪府大阪市北区梅田', '京都府京都市中京区'])}{rng.randint(1, 9)}丁目{rng.randint(1, 30)}-{rng.randint(1, 20)}"],
    }
    out = rng.choice(forms[country])
    return out.lower() if country in ("en", "de", "es") and rng.random() < 0.06 else out


MAKE = {"name": name, "email": email, "phone": phone, "id_number": ident, "address": address}

# Carrier lines; {N} name, {E} e-mail, {P} phone, {I} identity number, {A} address.
CARRIERS = {
    "en": """Hello, this is {N} writing about the lease.|The contract was drawn up by {N} in April.|We should invite {N} as well.|I spoke with {N} yesterday and nothing was settled.|{N} will bring the projector.|{N} wrote to us last night.|According to {N}, the meeting moved.|Thanks,\n{N}|Regards\n{N}|Hi {N}, are you free on Thursday?|my colleague {N} has the keys|Tell {N} that the train is late.|Is {N} still your landlord?|A parcel for {N} arrived.|Author: {N}|Contact person: {N}|The witness, {N}, was not present.|i'm {N} and i need help with an essay|The teacher of my daughter is {N}.|Give it to {N} or leave it at the desk.|please let {N} know|Yours sincerely, {N}|{N} and I share an office.|I was referred here by {N}.|{N} lives upstairs.|Write a farewell card for {N}, who retires in June.|It was {N} who called.|The email from {N} got lost.|Summarise what {N} said.|I work for {N} as an assistant.|Guest list: {N}, {N}, {N}|Patient {N} was seen at nine.|Translate this for {N}: good morning|
Write to {E} for details.|My mail is {E}, please use it.|Send a copy to {E} too.|E-mail address: {E}|Mails to {E} are returned.|Is {E} still valid?|You find me under {E} these days.|reply-to {E}|
You can phone me at {P} until ten.|My number: {P}|Text me on {P}.|T: {P}|WhatsApp {P}|The plumber can be reached on {P}.|Dial {P} and ask for the night shift.|Mobile {P}, office {P}|cell {P}|Please ring {P} when you arrive.|Her new number is {P}.|Telephone {P}|If nobody opens, call {P}.|
My passport is {I}.|SSN: {I}|The tax office knows me as {I}.|National insurance number {I}|ID {I}|Licence number {I} was issued in May.|Here is my identity card number: {I}|social security {I}|My taxpayer number, {I}, is on the form.|Passport no. {I}, valid until next year|The clerk noted {I} as my identity number.|
My home address is {A}.|Please send the books to {A}.|We live at {A} now.|She moved to {A} in spring.|Address: {A}|The courier should go to {A}.|Deliver everything to {A} after lunch.|Our house at {A} was flooded.|I grew up at {A}.|Meet me at {A} around five.|
{N}, {P}, {E}|{N}\n{A}|{N} <{E}>|{N} ({P})|Name: {N}\nPhone: {P}\nEmail: {E}|{N}; {A}; {P}|1. {N} - {E}\n2. {N} - {E}|Best,\n{N}\n{P}|{N}\n{P}\n{E}|{N}\n{E}|{N} / {E} / {P}|{P}, {N}|{E} {N}|{N}, {E}, {A}""",
    "de": """Hallo, hier schreibt {N} wegen der Wohnung.|Der Vertrag stammt von {N}.|{N} hat gestern angerufen.|Mit {N} habe ich schon gesprochen.|Viele Grüße\n{N}|Sehr geehrte {N},|Können Sie {N} Bescheid geben?|Mein Vermieter {N} meldet sich nicht.|Das Paket ist für {N}.|Ansprechpartner: {N}|Ich bin {N} und suche Hilfe.|
Schreiben Sie an {E}.|E-Mail: {E}|Meine neue Adresse lautet {E}.|Sie erreichen mich unter {P}.|Telefon: {P}|Handy {P}|Bitte um Rückruf: {P}|Die Nummer vom Hausmeister ist {P}.|Mein Reisepass hat die Nummer {I}.|Steuer-ID: {I}|Personalausweis {I}|Versicherungsnummer {I}|Meine Sozialversicherungsnummer lautet {I}.|Wir wohnen jetzt {A}.|Anschrift: {A}|Die Lieferung geht an {A}.|Unser Büro ist in der {A}.|{N}, {A}|{N}, Tel. {P}""",
    "fr": """Bonjour, c'est {N} pour le bail.|Le contrat a été signé par {N}.|{N} a appelé hier soir.|J'ai déjà parlé avec {N}.|Cordialement,\n{N}|Chère {N},|Pouvez-vous prévenir {N} ?|Mon propriétaire {N} ne répond pas.|Le colis est pour {N}.|Je suis {N} et je cherche de l'aide.|
Écrivez à {E}.|Courriel : {E}|Mon adresse électronique est {E}.|On peut me joindre au {P}.|Téléphone : {P}|Portable {P}|Le numéro du gardien est le {P}.|Mon passeport porte le numéro {I}.|Sécurité sociale : {I}|Carte d'identité {I}|Mon numéro fiscal est {I}.|Nous habitons maintenant {A}.|Adresse postale : {A}|La livraison se fera au {A}.|{N}, {A}|{N}, tél. {P}""",
    "es": """Hola, soy {N} y llamo por el piso.|El contrato lo firmó {N}.|{N} llamó anoche.|Ya hablé con {N}.|Un abrazo,\n{N}|Estimado {N}:|¿Puede avisar a {N}?|Mi casero {N} no contesta.|El paquete es para {N}.|
Escriba a {E}.|Correo: {E}|Mi correo nuevo es {E}.|Mi teléfono es el {P}.|Teléfono: {P}|Móvil {P}|Pueden localizarme en el {P}.|Mi pasaporte es el {I}.|DNI: {I}|El número de mi documento es {I}.|NIF {I}|Ahora vivimos en {A}.|Domicilio: {A}|La entrega será en {A}.|{N}, {A}|{N}, tel. {P}""",
    "it": """Buongiorno, sono {N} per l'affitto.|Il contratto è stato firmato da {N}.|{N} ha chiamato ieri.|Ho parlato con {N}.|Cordiali saluti,\n{N}|Caro {N},|Il pacco è per {N}.|Scrivete a {E}.|Il mio numero è {P}.|Telefono: {P}|Codice fiscale: {I}|La mia carta d'identità è {I}.|Abitiamo in {A}.|Indirizzo: {A}""",
    "pt": """Olá, aqui é {N} por causa do aluguel.|O contrato foi assinado por {N}.|{N} ligou ontem.|Já falei com {N}.|Abraços,\n{N}|Prezada {N},|A encomenda é para {N}.|Escreva para {E}.|O meu número é {P}.|Telefone: {P}|CPF: {I}|O meu documento é {I}.|Moramos em {A}.|Endereço: {A}""",
}
CARRIERS["xx"] = CARRIERS["en"]
LINES = {c: [x.strip("\n") for x in t.replace("|\n", "|").split("|") if x.strip()] for c, t in CARRIERS.items()}

# Words that methods, products, teams and places are named by, for look-alikes.
PLAIN = "linear binary global local open deep fast quick secret silver golden red green central upper northern digital visual basic logic search sort tree river garden bridge market office support sales service project design data network cloud signal light power energy system engine studio world home summer winter budget quality public human mental social solar dynamic static virtual parallel normal standard".split()
KINDS = "Method Algorithm Rule Test Theorem Model Search Sort Filter Team Department Desk Office Committee Library Museum Park Station Bridge Hotel Academy University Festival Project Framework Editor Server Street Kernel Process Distribution Index Score Equation Integral Sampling".split()
PLACES = ("New York|San Francisco|Los Angeles|Buenos Aires|Santa Cruz|Saint Petersburg|Rio de Janeiro|Hong Kong|Costa Rica|Sri Lanka|South Africa|North America|Great Britain|Lake Garda|Mount Everest|Puerto Rico|San Diego|Las Vegas|Cape Town|Tel Aviv|Abu Dhabi|Kuala Lumpur").split("|")
METHODS = ("Monte Carlo|Gauss Seidel|Newton Raphson|Runge Kutta|Naive Bayes|Black Scholes|Markov Chain|Turing Machine|Nash Equilibrium|Fourier Transform|Poisson Distribution|Bubble Sort|Quick Sort|Merge Sort|Logistic Regression|Neural Network|Decision Tree|Hidden Markov Model|Bloom Filter|Lorem Ipsum|Hello World|Stack Overflow|Visual Basic|Machine Learning|Game Theory|World Cup|Prime Minister|Middle Ages|Second World War|Grand Canyon|Business Model Canvas|Big Bang").split("|")


def _thing(rng: random.Random) -> str:
    roll = rng.random()
    if roll < 0.3:
        return rng.choice(METHODS)
    if roll < 0.5:
        return rng.choice(PLACES)
    if roll < 0.75:
        return f"{rng.choice(PLAIN).title()} {rng.choice(KINDS)}"
    if roll < 0.85:
        return f"{rng.choice(PLAIN).title()} {rng.choice(PLAIN).title()}" + rng.choice(["", f" {rng.choice(KINDS)}"])
    return f"{syllables(rng, 2)} {rng.choice(KINDS)}"


DECOYS = """The release {n}.{n}.{d1} fixes the crash.|Upgrade from {n}.{n} to {n}.{n}.{d2} first.|Exit status 0x{d8} means out of memory.|Your purchase 20{d2}-{d5} has left the depot.|Order number {d3}-{d7}-{d7}|Evaluate {d4}-{d3}+{d4} without a calculator.|{d3} * {d4} = {d7}|What is {d3}+{d4}-{d4}?|Simplify {d4}-{d4}+{d2}-{d3}.|{d2}+{d3}-{d4} equals what?|Offer {d4}-{d4}-{d3} ends on Sunday.|Booking {d3}-{d5} was cancelled.|Docket {d4}-{d4} and docket {d4}-{d6} are missing.|Le dossier {d4}-{d6} est clos.|Le bon {d4}-{d5} manque.|Der Vorgang {d4}-{d4} ruht.|El albarán {d4}-{d6} falta.|ISBN 978-{d1}-{d3}-{d5}-{d1}|Invoice {d4}/{d4}|RFC {d4} and ISO {d4}-{d1} apply.|The proxy is 172.16.{n}.{n}:{d4}.|ping 192.168.{d1}.{n}|It lies at {n}.{d6}, -{n}.{d6}.|Between 19{d2} and 20{d2} prices rose by {n}.{d1} %.|The clip runs from 00:{d2}:{d2} to 01:{d2}:{d2}.|It happened on 20{d2}-0{d1}-1{d1} at 1{d1}:{d2}.|Ticket {d8} is still open.|Tracking number RR{d9}DE|Commit {d7} broke build {d5}.|The fee is {d2},{d3}.{d2} in total.|Part {d3}-{d4}-{d2} replaces {d3}-{d4}-{d1}.|Serial number {d12}|Population: {d1},{d3},{d3}|timestamp {d10}|At {d9} bytes the buffer overflows.|lot #{d9}|seed {d7}, epoch {n}|The checksum {d10} does not match.|page {d3}, line {d5}|{d4} x {d4} pixels|Approximately {d7} rows were read.|DOI 10.{d4}/{d7}|Port {d5} is taken on host 10.{n}.{n}.{n}.|Bestellung {d3}-{d6} ist unterwegs.|Rechnung {d4}-{d5} über {d3},{d2} Euro|Version {n}.{n}.{n} ist da.|La commande {d4}-{d6} est partie.|Facture n° {d4}{d4}|El pedido {d3}-{d6} salió ayer.|Versión {n}.{n}.{n}|Fattura {d4}/{d4}|Zeile {d5}, Spalte {n}|El total es {d3}.{d3},{d2}.|pi is 3.14159265358|the constant 6.02214076 is exact|UUID {d8}-{d4}-{d4}-{d4}-{d12}|{d3} {d3} {d3} people voted.|The primes 104729 and 1299709 were used.|
Explain {T} to a beginner.|How does {T} work?|We use {T} for that.|Compare {T} with {T}.|I want to visit {T} next year.|{T} is hard to understand.|The {T} opens at nine.|Greetings from {T}!|Ask the {T} about refunds.|Apply {T} to {n} samples.|The {T} closed last week.|Our trip to {T} was short.|Thank you,\nThe {T}|Regards,\n{T}|In {T} the weather is mild.|Is {T} better than {T}?|Was ist {T}?|Erkläre mir {T}.|Qu'est-ce que {T} ?|¿Qué es {T}?|Wir fahren nach {T}.|Che cos'è {T}?|A shop called {T} sells it.|{T} and {T} are related.|The book {T} has {d3} pages.|They met in {T} by chance.|
A dragon named {S} guards the tower.|The robot {S} counts to {n}.|Tell a tale about {S} the fox.|{S} walked into the forest and {S} did not return.|My cat {S} sleeps.|Write a poem about {S}.|A knight called {S} rides home.|The decorator @{s} is new.|Follow @{s} and #{s}.|npm install @{s}/{s}|user@host:~$ ls|git@{s}:{s}/{s}.git|
The street was empty at {n}.|{n} ways to save money on the road|A long way: {n} km of road|In {n} days we drive home.|Rue and avenue are French words.|Calle means street.|{n} people live in the square.|The place has {n} rows and a court.|Highway {n} is closed.|Chapter {n}, Rules of the Road|{n} street lamps were broken.|Main Road and Market Square are crowded.|
Dear Customer,|Dear Sir or Madam,|To whom it may concern|Best Regards|Kind Regards,|Hello World|Good Morning|Happy Birthday|Merry Christmas|Thank You|Mit freundlichen Grüßen|Guten Tag|Bonne Journée|Buenos Días|Step One: read.|United Nations|European Union|Microsoft Word and Google Docs|Python Script|Is Java Virtual Machine a compiler?|Monday Morning Meeting|Internet Explorer|Power Point""".replace("|\n", "|")
# Ordinary prose, without data of a person.
PROSE = """i am looking forward to hearing more|this is wonderful news for gardeners|i'm trying to knit a woollen jumper|my friend bakes sourdough loaves|the teacher explained photosynthesis twice|dear reader, welcome back|Overnight oats soak in lukewarm milk. Afterwards they thicken.|Pruning rosebushes early encourages sturdier blossoms.|
Ich bin unterwegs zum Bahnhof.|Die Waschmaschine schleudert zu laut. Danach tropft der Schlauch.|Kräutertee hilft gegen Halsschmerzen. Trotzdem sollte man schlafen.|Unser Dachboden braucht dringend Dämmung. Handwerker sind selten.|Der Wetterbericht meldet Gewitter. Morgen scheint die Sonne.|Mein Nachbar gießt abends die Tomaten.|Für Einsteiger eignet sich Holzspielzeug. Schrauben Sie langsam.|
Je suis étudiante en troisième année.|L'entretien des vélos demande quelques outils.|Il faut d'abord égoutter les pâtes, puis les mélanger.|La voisine arrose ses géraniums.|Quelqu'un a déposé l'enveloppe dans l'entrée.|L'apprentissage du violoncelle prend des années.|Merci pour l'explication détaillée.|
Soy estudiante de enfermería.|La lavadora pierde agua desde anoche.|El vecino toca el violonchelo.|Aprender ajedrez mejora la concentración.|Para la ensalada hacen falta pepinos frescos.|Es una receta clara y sencilla.|El autobús llegó tarde por la niebla.|
Sono contenta di imparare la fisarmonica.|La lavatrice perde acqua da ieri.|Una spiegazione chiara aiuta gli studenti.|L'orto richiede annaffiature regolari.|Serve pazienza per la lievitazione lunga.|Il collega prepara l'insalata di finocchi.|
Sou estudante de enfermagem.|A máquina de lavar vaza desde ontem.|Aprender xadrez melhora a concentração.|Para a salada faltam pepinos frescos.|A leitura diária enriquece o vocabulário.|Uma explicação clara ajuda os alunos.|O vizinho rega as hortênsias.|
ahorro a largo plazo en 20 años|inviato via posta in 3 giorni|El camino dura 4 horas.|Uma rua com 12 casas.|Na praça cabem 300 pessoas.|via satellite da 5 anni|El paseo costó 15 euros.|corso di lingua da 30 ore|une réponse claire facilite la suite|Une consigne claire évite bien des erreurs.|La pierre calcaire se fissure vite.|una frase chiara convince chiunque|Una domanda chiara ottiene risposte migliori.|La rosa gialla appassisce presto.|La vera difficoltà resta nascosta.|la rosa blanca florece tarde|you can mark assignments quickly|jack sockets corrode outdoors|they will harvest pumpkins|una luna clara ilumina senderos|Die rosa Schleife passt dazu.|un hugo bien fraîchement servi""".replace("|\n", "|")
DECOY_LINES = [x for x in (DECOYS + "|" + PROSE).split("|") if x.strip()]
FILLERS = "Can you help me with this?|Please keep it short.|What do you think?|I have two questions.|It is urgent.|Nothing else changed.|Danke im Voraus.|Das ist wichtig.|Merci d'avance.|C'est urgent.|Gracias de antemano.|Es urgente.|Grazie mille.|Obrigado desde já.".split("|")
COUNTRIES = ("en", "en", "en", "en", "de", "de", "fr", "fr", "es", "es", "it", "pt", "xx", "xx")


def fill(rng: random.Random, template: str, country: str) -> tuple[str, list[Segment]]:
    """A carrier line with its data."""
    kinds = {"N": "name", "E": "email", "P": "phone", "I": "id_number", "A": "address"}
    text, true, k = "", [], 0
    while k < len(template):
        end = template.find("}", k) if template[k] == "{" else -1
        if end < 0:
            text += template[k]
            k += 1
            continue
        key, k = template[k + 1 : end], end + 1
        if key in kinds:
            value = MAKE[kinds[key]](rng, country)
            true.append((len(text), len(text) + len(value), kinds[key]))
            text += value
        elif key == "T":
            text += _thing(rng)
        elif key in ("S", "s"):
            text += syllables(rng, 2) if key == "S" else syllables(rng, 2).lower()
        elif key == "n":
            text += str(rng.randint(1, 99))
        else:
            text += digits(rng, int(key[1:]))
    return text, true


def line(rng: random.Random) -> tuple[str, list[Segment]]:
    """One or two lines of text with the true segments."""
    country = rng.choice(COUNTRIES)
    parts = [fill(rng, rng.choice(LINES[country] if rng.random() < 0.55 else DECOY_LINES), country)]
    if rng.random() < 0.3:
        parts.insert(rng.randint(0, 1), fill(rng, rng.choice(FILLERS + DECOY_LINES[:40]), country))
    text, true = "", []
    for t, segments in parts:
        if text:
            text += rng.choice([" ", "\n", "\n\n"])
        true += [(b + len(text), e + len(text), k) for b, e, k in segments]
        text += t
    return text, true

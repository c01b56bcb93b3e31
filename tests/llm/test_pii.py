import collections
import random

from palaver.llm import pii, pii_lines
from palaver.llm.pii import PLACEHOLDER, Candidate, Finder, decode, find_in_messages, lexicon, train
from palaver.llm.pii_lines import MAKE


# Whole carrier lines and two countries (Poland, the Netherlands) that training never sees.
HELD_OUT = {
    "en": """The keys were handed over by {N} before the holidays.|Could somebody drive {N} to the airport?|{N} thinks we should repaint the fence.|I am {N}, the new treasurer.|Minutes taken by {N}|Forward the agenda to {E} as well.|Drop a line to {E} whenever you like.|Our hotline {P} is staffed all day.|phone {P}, evenings only|You may call {P} about the sofa.|His social security number reads {I}.|Passport {I} was stamped twice.|Type your tax id {I} into field seven.|Please deliver the piano to {A} on Friday.|The party is at my address, {A}.|{N} - {P} - {E}""",
    "de": """{N} kommt am Samstag vorbei.|Die Unterlagen liegen bei {N}.|Bitte antworten Sie an {E}.|Rufen Sie mich an: {P}.|Ausweisnummer {I}|Geliefert wird an {A}.""",
    "fr": """Le dossier a été rédigé par {N}.|{N} viendra samedi.|Répondez à {E}.|Appelez-moi au {P} ce soir.|Numéro de passeport : {I}|J'habite {A}.""",
    "es": """El informe lo redactó {N}.|{N} vive en Sevilla.|Respondan a {E}.|Llámame al {P} mañana.|Pasaporte: {I}|Vivo en {A}.""",
    "pl": """Umowę podpisała {N}.|Do: {N}, {A}|Please ask {N} about the concert.|Dear {N}, thank you.|{N} said that the train was late.|Phone: {P}|Adres: {A}|PESEL: {I}|E-mail: {E}|We live at {A}.|Call me on {P}.""",
    "nl": """Het contract is getekend door {N}.|Aan: {N}, {A}|Please ask {N} about the boat.|Dear {N}, thank you.|{N} wrote that the boat leaks.|Telefoon: {P}|Adres: {A}|BSN: {I}|E-mail: {E}|We live at {A}.|Call me on {P}.""",
    "none": """Firmware {n}.{n}.{d2} bricks the router.|The kernel panics at 0x{d8}.|Quote {d4}-{d4}-{d3} expires soon.|Solve {d4}+{d3}-{d4} by hand.|Router 10.0.{n}.{n} answers on port {d4}.|It stands at {n}.{d5}, {n}.{d5} on the map.|In 19{d2} there were {d3},{d3} inhabitants.|Explain Gaussian Elimination and Dynamic Programming.|The Harbour Committee meets in Nova Scotia.|Is Random Search worse than Grid Search?|A hamster called {S} escaped.|Kind Regards,\nThe Booking Office|Parcel RB{d9}NL is delayed.|The playlist has {d4} songs.|We climbed {d4} steps on {n} roads.|Der Lieferschein {d4}-{d5} fehlt.|La versión {n}.{n} falla.|Le colis {d4}-{d6} est perdu.""",
}


def test_held_out_lines_and_countries(monkeypatch):
    """Recall and precision by type on lines, and on two countries, that training does not hold."""
    used = {x for lines in pii_lines.LINES.values() for x in lines} | set(pii_lines.DECOY_LINES)
    held = {c: [x for x in t.split("|") if x.strip()] for c, t in HELD_OUT.items()}
    assert used.isdisjoint(x for lines in held.values() for x in lines) and not {"pl", "nl"} & set(pii_lines.PEOPLE)
    finder, rng = Finder(train(), lexicon()), random.Random(12345)
    people = {"pl": ("agnieszka zbigniew katarzyna krzysztof małgorzata piotr tomasz".split(), "kowalczyk nowak wiśniewska lewandowski mazur".split(), "ska ski czyk wicz".split()), "nl": ("daan femke joost maaike thijs ruben lotte".split(), "jansen bakker visser dijkstra vermeulen".split(), "stra sen man huis".split())}
    monkeypatch.setattr(pii_lines, "PEOPLE", pii_lines.PEOPLE | people)
    monkeypatch.setattr(pii_lines, "TITLED", pii_lines.TITLED | {"pl": ["Dr.", "Prof."], "nl": ["Dr.", "Mr."]})
    d, word = (lambda n: pii_lines.digits(rng, n)), (lambda: pii_lines.syllables(rng, 2))
    own = {
        "pl": {"phone": lambda: rng.choice([f"+48 {d(3)} {d(3)} {d(3)}", f"+48 22 {d(3)} {d(2)} {d(2)}", f"5{d(2)}-{d(3)}-{d(3)}"]), "id_number": lambda: rng.choice([f"{rng.randint(50, 99)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}{d(5)}", f"ABC {d(6)}", f"ARX{d(6)}"]), "address": lambda: rng.choice([f"ul. {word()} {rng.randint(1, 90)}", f"ul. {word()} {rng.randint(1, 90)}/{rng.randint(1, 20)}, {d(2)}-{d(3)} {word()}", f"al. {word()} {rng.randint(1, 90)}, {word()}"])},
        "nl": {"phone": lambda: rng.choice([f"+31 6 {d(8)}", f"06-{d(8)}", f"+31 20 {d(3)} {d(4)}", f"020-{d(7)}"]), "id_number": lambda: rng.choice([f"{d(4)}.{d(2)}.{d(3)}", d(9), f"NX{d(1)}K{d(3)}R{d(1)}"]), "address": lambda: rng.choice([f"{word()}straat {rng.randint(1, 200)}", f"{word()}laan {rng.randint(1, 200)}, {d(4)} AB {word()}", f"{word()}plein {rng.randint(1, 50)}, {word()}"])},
    }
    tally = {}
    for country, lines in held.items():
        for _ in range(60):
            for template in lines:
                base = country if country in people or country in pii_lines.PEOPLE else "en"
                make = {k: (lambda _, c, k=k, base=base: own[base][k]() if base in own and k in own[base] else MAKE[k](rng, base if k == "name" else "en")) if base in own else MAKE[k] for k in MAKE}
                monkeypatch.setattr(pii_lines, "MAKE", make)
                text, true = pii_lines.fill(rng, template, base)
                want = collections.Counter(k for _, _, k in true)
                got = collections.Counter(c.type for c in finder.find(text))
                for k in {*want, *got}:
                    t = tally.setdefault((country, k), [0, 0, 0])
                    both = min(want[k], got[k])
                    t[0], t[1], t[2] = t[0] + both, t[1] + got[k] - both, t[2] + want[k] - both
    for by in (lambda c, k: k, lambda c, k: c):
        sums = {}
        for (c, k), t in tally.items():
            sums[by(c, k)] = [x + y for x, y in zip(sums.get(by(c, k), [0, 0, 0]), t, strict=True)]
        for key, (hit, wrong, missed) in sorted(sums.items()):
            print(key, "precision", round(hit / max(1, hit + wrong), 3), "recall", round(hit / max(1, hit + missed), 3), "wrong", wrong)
            if key != "none":
                assert hit / (hit + wrong) >= 0.9 and hit / (hit + missed) >= 0.9, key
    wrong = sum(t[1] for (c, _), t in tally.items() if c == "none")
    assert wrong <= 0.04 * 60 * len(held["none"])


# Lines written after the field was finished, and measured once: nothing was changed for them.
BLIND = {
    "en": """Reminder: {N} takes over the night shift.|We owe {N} an apology.|The sofa belongs to {N} and will be fetched tomorrow.|Has anybody seen {N} today?|I was born {N} but changed it later.|My employer listed {N} as the emergency contact.|You could also try {E} instead.|New e-mail from today: {E}|Our fax machine has the number {P}.|She left {P} on my voicemail.|Number for the babysitter - {P}|The visa form shows {I} for me.|My driving licence {I} expires soon.|The taxi waited at {A} for an hour.|Mail for us goes to {A}.""",
    "de": """{N} übernimmt die Leitung.|Wir danken {N} herzlich.|Meine Mail lautet {E}.|Die Praxis hat die Nummer {P}.|Unsere neue Anschrift ist {A}.""",
    "fr": """{N} prend la relève lundi.|Nous remercions {N}.|Mon mail : {E}|Le cabinet a le {P}.|Notre bureau se trouve {A}.""",
    "it": """{N} arriva lunedì.|Ringraziamo {N}.|La mia mail è {E}.|Lo studio ha il numero {P}.|L'ufficio è in {A}.""",
    "none": """The firmware went from {n}.{n} to {n}.{n}.{d1} overnight.|Case {d4}-{d5} was closed in 20{d2}.|Multiply {d4} by {d3} and subtract {d4}.|Lot {d7} weighs {d3} kg.|We stayed in Costa Brava near Playa Grande.|The Ministry of Rural Affairs met twice.|Breadth First Search beats Depth First Search here.|A parrot called {S} speaks.|Warmest Wishes,\nThe Reading Circle|Server 172.20.{n}.{n} refused port {d4}.""",
}


def test_lines_written_afterwards():
    finder, rng = Finder(train(), lexicon()), random.Random(2024)
    tally, wrong = {}, 0
    for country, lines in BLIND.items():
        for template in lines.split("|"):
            for _ in range(80):
                text, true = pii_lines.fill(rng, template, country if country != "none" else "en")
                want, got = collections.Counter(k for _, _, k in true), collections.Counter(c.type for c in finder.find(text))
                for k in {*want, *got}:
                    both = min(want[k], got[k])
                    t = tally.setdefault(k, [0, 0])
                    t[0], t[1], wrong = t[0] + both, t[1] + want[k] - both, wrong + got[k] - both
    for k, (hit, missed) in tally.items():
        assert hit / (hit + missed) >= 0.9, k
    assert wrong <= 0.01 * sum(t[0] for t in tally.values())


def test_plain_sentences_of_no_template():
    finder = Finder(train(), lexicon())
    for text, want in (
        ("Please forward this to Zbigniew Kowalczyk before noon.", ["name"]),
        ("The invoice was paid by Rachel Goldberg in March.", ["name"]),
        ("Nguyen Thanh Hai will pick up the keys.", ["name"]),
        ("We live at ul. Marszałkowska 10/5, 00-590 Warszawa now.", ["address"]),
        ("我住在北京市朝阳区建国路88号", ["address"]),
        ("Codice fiscale RSSMRA85T10A562S", ["id_number"]),
        ("My card number is 4111 1111 1111 1111.", ["id_number"]),
        ("PESEL 44051401359", ["id_number"]),
    ):
        assert [c.type for c in finder.find(text)] == want, text


def test_decode_is_the_best_set():
    rng = random.Random(3)
    for _ in range(200):
        cs = [Candidate(b, b + rng.randint(1, 5), "t", (f"f{k}",)) for k, b in enumerate(rng.randint(0, 12) for _ in range(7))]
        w = {f"f{k}": rng.uniform(-1, 3) for k in range(7)}
        best = 0.0
        for mask in range(1 << len(cs)):
            pick = [c for k, c in enumerate(cs) if mask >> k & 1]
            spans = sorted((c.begin, c.end) for c in pick)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
                best = max(best, sum(w[c.features[0]] for c in pick))
        assert abs(sum(w[c.features[0]] for c in decode(cs, w)) - best) < 1e-9


def test_lookalikes_stay():
    finder = Finder(train(), lexicon())
    for text in ("Version 3.61.63 is out.", "It fails with 0x25030953.", "What is 965-70+9154?", "Add @dataclass above it.", "Explain Ridge Regression to a child.", "Warm regards,\nThe Billing Department", "High Street is a frequent name.", "", "   ", "a" * 200_000):
        assert finder.find(text) == [], text
    assert finder.find(None) == []


def test_replacement_keeps_the_rest(spark):
    conv = [("user", "Ring me at +４４ ７７００ ９００９５８ tonight.\n\nMail nadia-907@example.com now. 日本 😀"), ("assistant", None), ("user", ""), ("assistant", "I'm mehmet tormaran, we live at 14B Larkspur Avenue. My SSN is 629 78 4394")]
    rows = [(1, conv, conv[:1], "x"), (2, None, None, "x"), (3, [], None, "x")]
    m = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame(rows, f"battle_id int, ca {m}, cb {m}, mentions_note string")
    out = {r.battle_id: r for r in find_in_messages(df, ["battle_id", "mentions_note"], {"a": "ca", "b": "cb"}, replace=True).collect()}
    assert out[1].ca[0].content == f"Ring me at {PLACEHOLDER['phone']} tonight.\n\nMail {PLACEHOLDER['email']} now. 日本 😀"
    assert out[1].ca[1].content is None and out[1].ca[2].content == ""
    assert out[1].ca[3].content == f"I'm {PLACEHOLDER['name']}, we live at {PLACEHOLDER['address']}. My SSN is {PLACEHOLDER['id_number']}"
    got = sorted((x.side, x.message_no, x.pii_type, x.pii_no) for x in out[1].mentions)
    assert got == sorted([("a", 0, "phone", 1), ("a", 0, "email", 1), ("b", 0, "phone", 1), ("b", 0, "email", 1), ("a", 3, "name", 1), ("a", 3, "address", 1), ("a", 3, "id_number", 1)])
    assert out[2].ca is None and out[2].mentions == [] and out[3].ca == []
    assert find_in_messages(df.limit(0), ["battle_id"], {"a": "ca"}).count() == 0


def test_numbers_of_repeated_mentions():
    found = Finder(train(), lexicon()).find("Tell Esra Kollberg about it. If Esra Kollberg is out, wait.")
    assert [c.type for c in found] == ["name", "name"]


def test_check_digits():
    assert pii.checks("4111 1111 1111 1111") == ["luhn"] and pii.checks("4111 1111 1111 1112") == []
    assert pii.checks("44051401359") == ["pesel"] and pii.checks("12345678Z") == ["dni"]
    assert pii.checks("GB82 WEST 1234 5698 7654 32") == ["iban"] and pii.checks("529.982.247-25") == ["cpf"]


def test_the_gate_rejects_no_candidate():
    kind = {"email": "e", "phone": "d", "id_number": "d", "address": "r", "name": "n"}
    words, rng = lexicon(), random.Random(77)
    finder = Finder(train(), words)
    texts = [pii_lines.line(rng)[0] for _ in range(2000)]
    texts += ["12 Oak Blvd", "5 allée des Lilas", "B.P. 123", "Name: Tarek Velmont", "**Rosa Kest**", "[rosa kest]", "Kest, rosa!", "1234 A5", "AB123CD45", "x (AT) post.test", "Élan Ödmark", "SEÑOR kest", "m. kest", "Tarek B. Velmont", "7 IMPASSE Noire", "WALDSTRASSE 4", "Straße 3", "none at all", "x <at> post.test", "文三路8号"]
    for text in texts:
        text = pii.plain(text)
        assert {kind[c.type] for c in pii.candidates(text, words)} <= set(finder.kinds(text)), text
        assert pii.candidates(text, words, finder.kinds(text)) == pii.candidates(text, words), text

"""A small labelled table of invented sentences, made from carriers and slots by rule.

In a carrier {name}, {email}, {phone}, {address} and {id} stand for a mention; the words that announce it belong to the
carrier. {host}, {word}, {number} and the like are no mentions. Everything is invented, and written without regard to the
texts that the model is used on: names, streets and words are mostly put together from syllables, so that a model has little to
learn by heart and must go by shapes and neighbours.
"""

from __future__ import annotations

import random
import re

FIRST = (
    "Agnieszka Ahmed Alejandra Amara Anders Antoine Arjun Astrid Aurélie Beatriz Benedikt Birgit Bogdan Brigitte Carmen Chidi Chinwe Clara Connor Cristina Daisuke Damien Deepa Dietrich Dominik Ebba Eduardo Eilidh Ekaterina Emre Enrique Erik Esther Fatima Felicity Fiona Florian Francesca Gareth Georgina Giulia Gonzalo Guillaume "
    "Gustavo Hanna Haruto Heike Helena Hendrik Ignacio Imani Irina Isabel Ismail Jacek Javier Jiho Joanna Johannes Josefine Kateřina Kwame Lachlan Laila Lars Lorenzo Lucía Ludwig Magdalena Malik Manon Marcelo Margaux Mehmet Mei Mohamed Nadia Natalia Niklas Nneka Octavio Olga Omar Orla Pablo Patrik Petra "
    "Rajesh Rania Renata Ricardo Roberto Rosalind Ruth Sabine Samuel Sanjay Sebastian Sinéad Stefan Sunita Takumi Tatiana Thabo Theodora Thierry Ursula Valentina Vikram Wolfgang Yasmin Yolanda Zainab"
).split()
ONSETS = "b br c ch cl d dr f fl g gl gr h j k kr l m n p pr r s sch sh sl st t th tr v w y z".split()
VOWELS = "a e i o u a e i o au ei ie oo ou á é ö ü í".split()
CODAS = ["", "", "", "l", "m", "n", "r", "s", "t", "k", "nd", "rt", "ck", "x"]
TAILS = "ton ham ley son sen ski wicz ová ić man mann er stein bach feld dorf hof berger ez es ado eira ini elli ucci ier eau oux ard ov ova enko yan oğlu wala kar nathan moto mura yama da kawa ng wu lim oye ola eze dottir gaard lund vik holm quist".split()
TITLES = ["Mr.", "Mr", "Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Dr.", "Dr", "Prof.", "Señora", "señora", "señor", "Señor", "Madame", "madame", "Monsieur", "Frau", "Herr", "Hr.", "Mme", "Mlle", "M.", "Sr.", "Sra.", "Don", "Doña", "Sir"]
THINGS = "server cluster gateway pipeline bucket queue scheduler router adapter mailbox printer backup snapshot invoice contract schedule meeting badge locker laptop tenant account cache broker index table worker parser".split()
ROADS = ["Street", "St", "St.", "Lane", "Ave", "Ave.", "Avenue", "Rd", "Rd.", "Road", "Court", "Drive", "Dr.", "Way", "Close", "Boulevard", "Blvd", "Terrace", "Place", "Square", "Crescent", "Hill", "Row", "Walk"]
CITIES = "Lisbon Lyon Graz Bremen Malmö Porto Gent Leeds Turin Cork Sevilla Nantes Basel Brno Oslo Utrecht Denver Toronto Quito Nagoya".split()
PERSON = [
    # english
    "{name} will be out until Thursday.", "I spoke with {name} yesterday about the {thing}.", "Thanks to {name} the {thing} works again.", "According to HR, {name} joined in spring.", "Forward all questions to {name}.", "{name} and {name} share the {thing}.", "{name}, {name} and {name} were in the room.", "The review was done by {name}.",
    "Meeting notes ({name}): the {thing} is late.", "Owner: {name}", "Author: {name}, {word} team", "{name} wrote the first draft.", "{name} says that {host} needs a restart.", "Did {name} reply to you?", "We hired {name} as a contractor.", "{name}'s laptop has to be wiped.", "The customer, {name}, complained twice.", "Signed: {name}", "Regards, {name}",
    "Hi {name}, the {thing} is ready.", "Dear {name}, please find the {thing} below.", "cc: {name}", "Assigned to {name} since {date}.", "{name} (on leave) handed over to {name}.", "Only {name} knows the password of {host}.", "Talk to {name} before you change {host}.", "A complaint by {name} was closed.", "For {name} we made an exception.", "{name} from the {word} team signed it.",
    "Both {name} and {name} came along.", "{name} and {name} met in {City}.", "{name} and {name} fixed the {thing} together.", "Invite {name} and {name} too.", "Neither {name} nor {name} was told.", "cc {name} and {name}", "{name} or {name} can open the {thing}.", "Lunch: {name}, {name}", "To: {name}, {address}", "Parcel for {name}, {address}, {City}", "At Mrs {name}'s, {address}", "Chez {name}, {address}", "Bei {name}, {address}, klingeln.", "En casa de {name}, {address}",
    "The porter ({phone}) has a key.", "Ask the desk ({phone}) first.", "A new number, {phone}, replaces that one.", "Her line, {phone}, is busy.", "Caller id {phone}", "Dr. {name} ({phone})",
    "{name} <{email}>", "{name} ({email}) owns the {thing}.", "{name}, {phone}, {email}", "Reach {name} at {phone}.", "Reach {name} under {email}.", "Phone number of {name}: {phone}", "Emergency contact is {name}, {phone}.", "Send the {thing} to {email} today.", "Her mail address is {email}.", "Mail: {email}", "E-mail {email}, phone {phone}.", "You can write me at {email} any time.",
    "The form was sent by {email}.", "Bounced: {email}", "Everything goes through {email} now.", "Subscribed {email} and {email} to the list.", "mailto:{email}", "[{email}]", "Please dial {phone} for support.", "His mobile is {phone}.", "Fax: {phone}", "Hotline {phone} (weekdays).", "Text me on {phone}, not by mail.", "Number on file: {phone}", "The caller left {phone} as a number.", "Tel. {phone}",
    "Lives at {address}.", "Delivery to {address}, {City}.", "The new office is at {address} in {City}.", "Billing address: {address}, {zip} {City}", "Moved from {address} to {address}.", "{name} lives at {address}.", "{name}, {address}, {zip} {City}", "Pick it up at {address} before {time}.", "Our warehouse, {address}, is closed.", "Visit us: {address}",
    "{name} gave {id} as proof.", "Proof of identity: {id}", "The clerk noted {id}.", "Copy of {id} is in the file.", "Entered {id} for {name}.", "Paid to {name}, {id}.", "Please delete {id} from the {thing}.", "Applicant {name} has {id}.", "It shows {id} in clear text.", "Checked {id} against the register.", "{id} was found in the log of {host}.",
    # french
    "J'ai parlé avec {name} hier.", "Merci de prévenir {name} du retard.", "{name} est en congé jusqu'à lundi.", "Le contrat est signé par {name}.", "Contactez {name} au {phone}.", "Écrire à {email} pour le {thing}.", "Livraison au {address} à {City}.", "Elle habite {address}.", "Dossier de {name}, {id}.", "Selon {name}, c'est réglé.", "Bonjour {name}, voici le fichier.", "Rappeler le {phone} demain.",
    # german
    "Ich habe {name} gefragt.", "Wir haben {name} gebeten, zu helfen.", "Das Konto von {name}, Abteilung {Word}, ist gesperrt.", "{name}, Telefon {phone}, ist informiert.", "Avec {name}, tout va bien.", "Grâce à {name} la {thing} marche.", "Pregúntale a {name} por la clave.", "Se lo dije a {name} por correo.",
    "Ich habe mit {name} gesprochen.", "{name} ist bis Montag im Urlaub.", "Bitte an {name} weiterleiten.", "Der Vertrag wurde von {name} unterschrieben.", "Zuständig: {name}, Tel. {phone}", "Erreichbar unter {phone} oder {email}.", "Die Lieferung geht an {address}, {zip} {City}.", "Wohnhaft {address} in {City}.", "Liebe Grüße, {name}", "Laut {name} ist alles erledigt.", "Unterlagen von {name}: {id}", "Bei Fragen hilft {name} gern weiter.",
    # spanish
    "Hablé con {name} ayer.", "{name} está de vacaciones.", "El contrato lo firmó {name}.", "Escríbele a {email} hoy mismo.", "Mi teléfono es {phone}.", "Entregar en {address}, {City}.", "Vive en {address}.", "Según {name}, ya está listo.", "Estimada {name}: adjunto el informe.", "Datos de {name}: {id}", "El paquete es para {name}.", "Contacto: {name}, {phone}",
]
# titled words that are no persons
TITLED = [
    "We use {Word} {Word} as the editor.", "The {Word} {Word} release ships next week.", "Code names: {Word} {Word}, {Word} {Word} and {Word}.", "{Word} {Word} and {Word} {Word} are products, no one's names.", "{Word} {Word} is the name of a release.", "Release {Word} follows release {Word} {Word}.", "Project {Word} {Word} was renamed to {Word}.", "{Word} {Word} Inc. bought the {Word} Group.",
    "Install the tool {Word} {Word} from the store.", "Open the editor {Word} {Word} and press Save.", "The {Word} Team met the {Word} Board.", "On Monday Morning the {Word} Service failed.", "{Word} (the service) talks to {Word} Gateway.", "See chapter Data Model in {Word} Guide.", "The services {Word} and {Word} {Word} were merged.", "Known builds are {Word} {Word}, {Word} {Word}.", "Both {Word} and {Word} are names of builds.",
    "{Word} by design drops old rows.", "Milestone {Word} {Word} is done.", "{Word} {Word} edition of the {thing}.", "{Word} {Word}: notes for operators", "The {thing} called {Word} {Word} is empty.", "Restart {Word} after {Word} is up.", "Service {Word} with {host} waits.", "Tagged as {Word} {Word} in {City}.", "City of {City}, region {Word}.", "People in {City} noticed it first.", "{Word} {Word} are only labels for sprints.",
]
PLAIN = [
    # hosts, files, commands, keys
    "ssh {user}@{host}", "Copy it with scp {user}@{host}:/var/{word}.", "git clone git@{host}:{word}/{word}.git", "docker pull {word}/{word}@sha256:{hex}", "Image {word}/{word}:{number}@{hex} is gone.", "postgres://{user}:{word}@{host}:{number}/{word}", "Mention @{word} in the channel.", "Package @{word}/{word} at version {small}.{small}.{small}.", "Meet @ {time} in room {small}.", "{word}.{word}@{number} stays fixed.",
    "Host {host} has address {ip}.", "{ip}:{number} refuses connections.", "Subnet {ip}/24 belongs to {host}.", "Commit {hex} broke `{word}_{word}`.", "Call `{word}.{word}()` with {number}.", "Edit /etc/{word}/{word}.conf on {host}.", "Set {WORD}_{WORD} to {number}.", "{WORD} {WORD} must be upper case.", "Run {word} --{word}={number} on {host}.", "Link [[{word}_{word}]] and [[{word}-{word}#{Word}]].",
    "- {word}: {number}", "# {Word} {word}", "| {word} | {number} | {host} |", "Log line: {date} {time} {WORD} {word} {number}", "https://{word}.example/{word}?{word}={number}", "uuid {hex}-{four}-{four}-{hex}", "checksum {hex}{hex}", "Line {number} of {word}/{word}.py raises {Word}Error.", "> source: {word} {hex}",
    # numbers that identify no person
    "Order {ticket} is open.", "Ticket {ticket} is a duplicate of {ticket}.", "Case {tick}-{number} follows {tick}-{number}.", "Build {build} passed.", "Between builds {build} and {build} nothing changed.", "Bill {number}-{number} over {number}.{two} euros.", "Lot {number}-{number} needed {number} s.", "Port {number} on {host} is open.", "Part no. {tick}{number}-{small}", "Serial {hex}, rack {small}.", "HTTP code {number}, then {number} again", "Error {number} in {word}, exit code {small}", "{word} ended with {number}", "Counter is at {long}.",
    "The id of the run is {long}.", "Epoch {long} means {date}.", "{number} of {number} rows, {small} parts", "Row {number}, column {small}, value {small}.{two}", "Budget: {number} {word} and {number} {word}", "At {time} on {date} load was {small}.{two}.", "{date}: {number} rows, {date}: {number} rows", "Version {small}.{small}.{number} on {number} machines.", "ISO {number}-{small}:{date} applies.", "{number} {word} {thing}s were moved.", "We counted {number} Main {thing}s.",
    # plain talk in four languages
    "The {thing} was slow, so we waited.", "Nobody knows why the {thing} stops.", "Please keep the {thing} below {number}.", "Mind that one {word} {thing} differs from every {word} {thing}.", "After {number} tries the {thing} gave up.", "Usually this takes {number} minutes; then {host} answers.", "Decided: we keep the {thing}.", "Reminder: rotate the {thing} on {date}.", "It helps to read the {thing} twice.", "There are {small} ways to do it.",
    "Le serveur {host} ne répond plus depuis {time}.", "La table {word} compte {number} lignes.", "Il faut relancer le service {Word} avant midi.", "Voir aussi le chapitre {Word} du guide.", "Cette panne a duré {number} minutes.", "L'équipe {Word} a changé la règle {word}.", "Der Dienst {Word} auf {host} antwortet nicht.", "Die Tabelle {word} hat {number} Zeilen.", "Bitte den Server vor dem Update sichern.", "Nach dem Neustart läuft die Anwendung wieder.",
    "Im Handbuch steht, dass der Speicher für {number} Einträge reicht.", "Das Team {Word} prüft die Sicherung am Montag.", "El servidor {host} tarda {number} segundos.", "La tabla {word} tiene {number} filas.", "Hay que reiniciar el servicio {Word} esta noche.", "El equipo {Word} cambió la regla {word}.", "Después de {number} intentos falló la copia.", "Conviene leer la guía de {Word} antes.",
]
OPENERS = ["Later ", "By the way, ", "Today ", "In short, ", "As expected, ", "Since {date} ", "At {time} ", "For {host}, ", "With {word} on ", "Hier ", "Heute ", "Ayer ", "Once the {word} {thing} moved, ", "Again "]
ENDINGS = [" (see {host})", ", as of {date}", " since {time}", ", which is fine", ", whereupon {host} stopped", ", compare [[{word}-{word}]]", " because the {thing} was full", ", not {word}", " like the {word} {thing}", "; more in {word}.md"]
SLOT = re.compile(r"\{(\w+)\}")


def syllable(r: random.Random) -> str:
    return r.choice(ONSETS) + r.choice(VOWELS) + r.choice(CODAS)


def word(r: random.Random) -> str:
    """A lower-case word of one to three syllables, mostly without accents."""
    out = "".join(syllable(r) for _ in range(r.choice([1, 2, 2, 3])))
    return out if r.random() < 0.1 else out.translate(str.maketrans("áéíöü", "aeiou"))


def last(r: random.Random) -> str:
    """A surname."""
    out = word(r) + (r.choice(TAILS) if r.random() < 0.7 else "")
    return ("" if r.random() < 0.93 else r.choice(["Mc", "O'", "Mac", "D'"])) + out.title()


def first(r: random.Random) -> str:
    return r.choice(FIRST) if r.random() < 0.65 else (word(r) + r.choice(["", "a", "o", "e", "ine", "us", "ina", "y", "an", "el"])).title()


def letter(r: random.Random) -> str:
    return r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ")


def name(r: random.Random) -> tuple[str, str]:
    """(title or empty, name)."""
    kind, f, s = r.random(), first(r), last(r)
    if r.random() < 0.17:
        s += "-" + last(r)
    if kind < 0.18:
        return r.choice(TITLES) + " ", s if r.random() < 0.75 else f"{f} {s}"
    if kind < 0.29:
        return "", f"{letter(r)}. {s}" if r.random() < 0.8 else f"{letter(r)}. {letter(r)}. {s}"
    if kind < 0.38:
        return "", f"{s}, {f}"
    if kind < 0.47:
        return "", f"{f} {s}".upper()
    if kind < 0.57:
        return "", f"{f} {letter(r)}. {s}"
    if kind < 0.7:
        return "", f"{f} {r.choice(['van', 'von', 'de', 'da', 'van der', 'de la', 'al', 'bin', 'di'])} {s}"
    if kind < 0.68:
        return "", f"{f}-{first(r)} {s}"
    if kind < 0.74:
        return "", f"{f} {first(r)} {s}" if r.random() < 0.6 else f"{f} {s} {last(r)}"
    return "", f"{f} {s}"


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def plain_letters(text: str) -> str:
    return re.sub("[^a-z]", "", text.lower().translate(str.maketrans("áéíöüğćñø", "aeiougcno"))) or "x"


def email(r: random.Random) -> str:
    f, s, t = plain_letters(first(r)), plain_letters(last(r)), plain_letters(word(r))
    user = r.choice([f"{f}.{s}", f"{f}{r.randint(1, 99)}", f"{f}_{s}", f"{f}_{s}{r.randint(1, 99)}", f"{s}-{f}", f"{f[0]}{s}", f"{f[0]}.{s}", s, f"{f}.{s}+{t}", f"{s}-{t}-{f}", f"{f}.{s}-{t}", f"{t}{digits(r, 3)}"])
    host = plain_letters(word(r))
    domain = r.choice([f"{host}.com", f"{host}.org", f"mail.{host}.net", f"{host}.co.uk", f"{host}.de", f"{host}-{t}.fr", f"{host}.{t}.example", f"{host}.invalid", f"{host}-{t}.test", "example.com", "example.net", f"{host}.io", f"{host}.es"])
    kind = r.random()
    if kind < 0.68:
        out = f"{user}@{domain}"
    elif kind < 0.72:
        out = f"{user} @ {domain}"
    elif kind < 0.9:
        at, dot = r.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", "."), (" [at] ", "."), (" {at} ", " {dot} ")])
        out = user + at + domain.replace(".", dot)
    else:
        out = f"{user.replace('.', ' dot ')} at {domain.replace('.', ' dot ')}"
    return out.upper() if r.random() < 0.08 else out


def phone(r: random.Random) -> str:
    a, b = str(r.randint(200, 989)), digits(r, 4)
    d = lambda n: digits(r, n)
    return r.choice([
        f"+1 {a} {d(3)} {b}", f"+1{a}{d(3)}{b}", f"1{a}{d(3)}{b}", f"({a}) {d(3)}-{b}", f"{a}-{d(3)}-{b}", f"{a}.{d(3)}.{b}", f"+1-{a}-{d(3)}-{b}", f"+1 ({a}) {d(3)}-{b}", f"{a} {d(3)} {b}",
        f"+44 (0){d(4)} {d(6)}", f"0{d(4)}-{d(6)}", f"0{d(4)} {d(6)}", f"+44 {d(2)} {d(4)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"+44 7{d(3)} {d(6)}",
        f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 {d(2)} {d(5)} {d(3)}", f"0{d(2)}/{d(8)}", f"0{d(3)}/{d(6)}", f"+49 1{d(2)} {d(7)}", f"01{d(2)} {d(7)}", f"0{d(3)} {d(7)}", f"+34 {d(2)} {d(3)} {d(4)}", f"+34 {d(3)} {d(3)} {d(3)}", f"{r.choice('69')}{d(2)} {d(2)} {d(2)} {d(2)}", f"00{d(2)} {d(2)} {d(7)}",
    ])


def address(r: random.Random) -> str:
    n, s, kind = r.randint(1, 990), last(r) if r.random() < 0.5 else word(r).title(), r.random()
    unit = r.choice(["", "", "", f", Apt {r.randint(1, 60)}", f", Apt. {r.randint(1, 60)}{letter(r)}", f", Suite {r.randint(100, 990)}", f" Unit {r.randint(1, 9)}{letter(r)}", f", Flat {r.randint(1, 20)}", f", Unit {r.randint(1, 40)}", f" #{r.randint(1, 90)}", f", Floor {r.randint(1, 9)}"])
    if kind < 0.5:
        number = f"{n}{r.choice('abcAB')}" if r.random() < 0.2 else str(n)
        side = f"{r.choice(['N.', 'S.', 'E.', 'W.', 'North', 'West'])} " if r.random() < 0.2 else ""
        return f"{number} {side}{s}{' ' + word(r).title() if r.random() < 0.15 else ''} {r.choice(ROADS)}{unit}"
    if kind < 0.67:
        way = r.choice(["rue", "avenue", "impasse", "quai", "boulevard", "place", "allée", "chemin"])
        return f"{n % 199 + 1}{r.choice(['', ',', ' bis,', ' bis', ' ter,'])} {way} {r.choice(['de la ', 'du ', 'des ', 'de ', ''])}{s}{' ' + word(r).title() if r.random() < 0.3 else ''}"
    if kind < 0.84:
        way = r.choice(["Calle", "Calle", "Calle de", "Calle del", "Calle de la", "Avda.", "Avda. de", "Avenida", "Plaza de", "Paseo", "Paseo de la", "Camino", "Ronda de"])
        return f"{way} {s}{r.choice([',', '', ',', ' n.º'])} {n % 199 + 1}{r.choice(['', '', ', 3.º B', ', 1.º'])}"
    low = s.lower()
    way = r.choice([f"{s}straße", f"{s}str.", f"{s}gasse", f"{s}weg", f"{s} Weg", f"{s}platz", f"{s}allee", f"Am {s}", f"Im {s}", f"An der {s}", f"Alte {s}straße", f"{s}er Straße", f"{s}er Weg", f"Am Alten {s}", f"Zum {s}", f"{s}ufer", f"{s}-{low.title()}-Straße"])
    return f"{way} {n % 199 + 1}{r.choice(['', '', 'a', 'b', ' c'])}"


def identity(r: random.Random) -> tuple[str, str]:
    """(announcing words, number)."""
    upper = lambda n: "".join(letter(r) for _ in range(n))
    d = lambda n: digits(r, n)
    word_, number = r.choice([
        ("", f"{d(3)}-{d(2)}-{d(4)}"), ("", f"{d(3)}-{d(2)}-{d(4)}"), ("SSN", f"{d(3)}-{d(2)}-{d(4)}"), ("ssn", f"{d(3)} {d(2)} {d(4)}"), ("ssn", f"{d(3)} {d(2)} {d(4)}"), ("SSN", d(9)), ("social security", f"{d(3)}-{d(2)}-{d(4)}"), ("social security number", f"{d(3)} {d(2)} {d(4)}"), ("NI number", f"{upper(2)} {d(2)} {d(2)} {d(2)} {upper(1)}"), ("national insurance", f"{upper(2)}{d(6)}{upper(1)}"),
        ("passport", upper(2) + d(6)), ("passport", upper(1) + d(7)), ("passport", upper(1) + d(8)), ("passport no.", d(9)), ("Passport", upper(2) + d(7)), ("passeport", f"{d(2)}{upper(2)}{d(5)}"), ("pasaporte", f"{upper(3)}{d(6)}"), ("Reisepass", f"C{d(1)}{upper(2)}{d(5)}"),
        ("tax id", f"{d(2)}-{d(7)}"), ("tax number", f"{d(3)}/{d(3)}/{d(5)}"), ("TIN", d(10)), ("Steuer-ID", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("EIN", f"{d(2)}-{d(7)}"), ("NIF", f"{d(8)}{upper(1)}"),
        ("national id", f"{d(6)}-{d(4)}"), ("national id", f"{d(8)}-{d(4)}"), ("national id", d(11)), ("identity card", f"{upper(3)} {d(6)}"), ("DNI", f"{d(8)}-{upper(1)}"), ("DNI", f"{d(8)}{upper(1)}"), ("Personalausweis", f"L{d(1)}{upper(1)}{d(4)}"), ("Personalausweis", f"L{d(2)}{upper(1)}{d(2)}{upper(1)}{d(2)}"), ("CNI", d(12)), ("CPF", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"), ("numéro de sécurité sociale", f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}"),
        ("driving licence", f"{upper(5)}{d(6)}{upper(2)}{d(1)}{upper(2)}"), ("driving licence", f"{upper(4)}{d(7)}{upper(1)}{d(1)}{upper(2)}"), ("licence", f"{upper(2)}{d(8)}{upper(1)}{d(1)}{upper(2)}"), ("licence", f"{upper(3)}{d(7)}{upper(1)}{d(1)}{upper(2)}"), ("driver's license", upper(1) + d(7)), ("license number", upper(1) + d(12)), ("Führerschein", f"{upper(1)}{d(3)}{upper(2)}{d(4)}{upper(1)}"), ("permis de conduire", d(12)),
    ])
    return (word_ + r.choice([" ", " ", ": ", " no. ", " number "]) if word_ and not word_.endswith((".", "number")) else word_ + " " if word_ else ""), number


def other(r: random.Random, slot: str) -> str:
    w, n = word(r), r.randint(2, 9999)
    return {
        "word": w, "Word": w.title(), "WORD": w.upper(), "thing": r.choice(THINGS), "host": f"{w}-{r.choice([str(r.randint(1, 400)), word(r)])}", "number": str(n), "small": str(r.randint(1, 30)), "two": digits(r, 2), "four": digits(r, 4), "long": digits(r, r.choice([7, 8, 10, 13])), "time": f"{r.randint(0, 23):02}:{r.randint(0, 59):02}",
        "hex": "".join(r.choice("0123456789abcdef") for _ in range(r.choice([7, 12, 16]))), "ip": f"10.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", "ticket": f"{r.randint(1000, 9999)}-{digits(r, 2)}-{digits(r, 4)}", "tick": w[:3].upper(), "user": r.choice(["root", "deploy", "git", "admin", w]), "City": r.choice(CITIES), "zip": digits(r, 5),
        "build": f"20{digits(r, 2)}0{r.randint(1, 9)}{r.randint(10, 28)}{r.choice(['-', '.'])}{digits(r, r.choice([2, 4]))}", "date": r.choice([f"20{digits(r, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{digits(r, 2)}"]),
    }[slot]


def plain(r: random.Random) -> str:
    """A carrier without a mention, often with an opening and an ending."""
    out = r.choice(TITLED if r.random() < 0.13 else PLAIN)
    if r.random() < 0.3 and out[0] not in "#->|`":
        out = r.choice(OPENERS) + (out[0].lower() if out[0] != "{" else out[0]) + out[1:]
    if r.random() < 0.3 and out.endswith("."):
        out = out[:-1] + r.choice(ENDINGS) + "."
    return out


def fill(r: random.Random, carrier: str) -> tuple[str, list[tuple[int, int, str]]]:
    out, spans, at = "", [], 0
    for m in SLOT.finditer(carrier):
        out += carrier[at : m.start()]
        at, slot = m.end(), m[1]
        before, text, kind = "", "", slot
        if slot == "name":
            before, text = name(r)
        elif slot == "id":
            (before, text), kind = identity(r), "id_number"
        elif slot in ("email", "phone", "address"):
            text = {"email": email, "phone": phone, "address": address}[slot](r)
        else:
            out += other(r, slot)
            continue
        spans.append((len(out) + len(before), len(out) + len(before) + len(text), kind))
        out += before + text
    return out + carrier[at:], spans


#: Words of the carriers, for sentences without sense; they teach that a mention can stand beside any word.
SALAD = sorted({w for c in PERSON + TITLED + PLAIN for w in re.findall(r"(?<![\w{])[^\W\d_]{2,}(?![\w}])", SLOT.sub(" ", c)) if w == w.lower()})


def technical(r: random.Random) -> str:
    """A piece of technical Markdown: a service, file, setting, link, number or the like, by its form."""
    w, v, n = word(r), word(r), r.randint(1, 9999)
    service, mark = f"{w}-{r.choice([v, str(r.randint(1, 500))])}", "".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 5)))
    link = f"{v}_{service}{r.choice(['', '-' + mark, '_' + mark])}{r.choice(['', '', '.md'])}"
    return r.choice([
        service, service, f"`{service}`", f"`{service}`", service.title(), service.capitalize(), service.capitalize(), service.upper(), f"{w}/{service}.{r.choice(['yaml', 'json', 'toml', 'log', 'py', 'sh'])}", f"{w}/{v}/{w}.{r.choice(['txt', 'md', 'cfg'])}", f"{w}_{v}", f"{w}_{v} at {n}", f"{w}_{v} to {n}", f"{w}_{v} is {n}", f"`{w} {v} --{w}`", f"`{w}ctl {v}`",
        f"[[{link}]]", f"[[ {link} ]]", f"[[{link}#{w.title()}]]", f"[[{link}#{mark}. {w.title()}]]", f"[[{link}|{w} {v}]]", f"per [[{link}]];", str(n), f"{n} {v}s", f"{n} {w} {v}s", f"{n} percent", f"port {n}", f"{w[:3].upper()}-{n}", f"{r.randint(0, 23):02}:{r.randint(0, 59):02}", f"- {w}", "—", f"({service})", f"{user(r)}@{service}:/{w}/{v}", f"{w}/{v}:{mark}@{'sha256' if r.random() < 0.5 else w}:{mark}{n}", w.title(), f"the {w.title()} {r.choice(THINGS)}", f"{n}-{n}",
    ])


def user(r: random.Random) -> str:
    return r.choice(["root", "deploy", "admin", "git", "runner", "ops", word(r)])


def heading(r: random.Random) -> str:
    return "#" * r.randint(1, 4) + r.choice([" ", f" {r.randint(1, 20)}. ", f" {r.randint(1, 9)}.{r.randint(1, 9)} "]) + (lambda x: x if r.random() < 0.4 else x.title() if r.random() < 0.3 else x.capitalize())(" ".join(word(r) if r.random() < 0.5 else r.choice(THINGS + SALAD) for _ in range(r.choice([1, 1, 1, 2, 3, 5]))))


def salad(r: random.Random) -> str:
    """A carrier of words in no order around one or two slots of mentions, or none."""
    piece = lambda: r.choice(SALAD) if r.random() < 0.6 else "{word}" if r.random() < 0.5 else technical(r)
    some = lambda n: [piece() for _ in range(r.randint(0, n))]
    slot = lambda: r.choices(["{name}", "{email}", "{phone}", "{address}", "{id}"], [18, 2, 3, 3, 2])[0]
    parts = some(4)
    kind = r.random()
    if kind < 0.08:
        return heading(r)
    if kind < 0.7:
        mention = slot()
        if r.random() < 0.2:
            mention = r.choice(["({})", "{},", "{}:", "{};", "- {}", '"{}"', "<{}>"]).replace("{}", mention)
        if mention == "{address}" and r.random() < 0.5:
            mention += r.choice([", {City}", ", {City},", " in {City}", ", {zip} {City}", " {City}"])
        if mention == "{name}" and r.random() < 0.3:
            mention += r.choice([", {Word}", ", {Word} {word}", ", {Word} {Word}", ", {phone}", ", {Word} {phone}", " ({email})", " <{email}>", ", {address}", ", {address}", ", {address}"])
        parts += [mention, *some(4)]
        if r.random() < 0.35:
            parts += [r.choice(["and", "and", "or", ",", "und", "et", "y", "at", ":"]), "{name}" if mention == "{name}" and r.random() < 0.5 else slot(), *some(3)]
    else:
        parts += [technical(r) if r.random() < 0.5 else piece() for _ in range(r.randint(1, 12))]
    out = " ".join(parts).replace(" ,", ",").replace(" :", ":") or "{word}"
    if "{" in out and r.random() < 0.04 and not SLOT.search(out.replace("{word}", "")):
        out = out.replace("{word}", word(r)).upper()
    out = out[0].upper() + out[1:] if out[0] != "{" else out
    return out + r.choice([".", ".", ".", "", "?", "!"])


def table(rows: int = 4_800, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``rows`` labelled lines (text, [(start, end, kind)]) of one to four sentences."""
    r = random.Random(seed)
    out = []
    for i in range(rows):
        text, spans = "", []
        kinds = [salad(r) if i % 2 == 0 else PERSON[i % len(PERSON)]] + [plain(r) for _ in range(r.randint(0, 2))] + ([r.choice(PERSON)] if r.random() < 0.3 else [])
        r.shuffle(kinds)
        for carrier in kinds:
            part, found = fill(r, carrier)
            if r.random() < 0.08 and len(part.upper()) == len(part):
                part = part.upper()
            if text:
                text = (text[:-1] if r.random() < 0.15 and text.endswith(".") and not (spans and spans[-1][1] == len(text)) else text) + " "
            spans += [(a + len(text), b + len(text), k) for a, b, k in found]
            text += part
        out.append((text, spans))
    return out

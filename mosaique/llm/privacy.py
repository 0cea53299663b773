"""Personal data and secrets: keyed surrogates instead of blanks.

A detected entity is replaced by another of its kind: an e-mail address by an address of the same shape, a
card number by one with the same network digit and valid check digit, a phone number in the same
notation, an IPv4 address of the same class, a secret with the same alphabet, a given name by one of the same
gender and script, a surname by one with the same pattern of vowels and consonants in the same script.

Surrogates come from a keyed permutation without fixed points of all values of the same shape, so different
values get different surrogates, equal values (however they are written) get equal ones in every document,
and no value stays. Values that such a permutation can't cover get a keyed hash; `ledger` checks all
distinct entities of the corpus for surrogates that meet, and draws those anew until none do. It holds keyed
digests of values and surrogates, never the values.

Whoever has the key can undo the permutations. It comes from the session's setting `spark.mosaique.secret.key`; a
session without one gets a random key of its own, so that its surrogates agree within the session only.

Cases: a null text stays null, empty texts and texts without entities stay as they are, repeated rows each get
a row, an empty table gives an empty result, other columns are ignored by `replace` and kept by `replace_in`.
Digits of other scripts count as digits and are replaced by digits of their script; octets with leading zeros
equal those without and keep their width.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mosaique.llm.common import BROADCAST_ROWS
from mosaique.session import materialize

#: The setting of the session that holds the key. Its name makes Spark redact it in logs and pages.
KEY_SETTING = "spark.mosaique.secret.key"

#: What stands before an @, and the domain behind it.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+'-")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
#: The word may end a longer name (DB_PASSWORD, aws_secret_access_key). Values of password words need no digit.
_SECRET = re.compile(r"(?i)(?:(?P<word>password|passwd|pwd|passphrase)|secret[_-]?key|private[_-]?key|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?(?P<value>[A-Za-z0-9+/_.-]{8,}[A-Za-z0-9+/=_-])")
_KEY_PREFIX = re.compile(r"(?<![A-Za-z0-9])(?:ghp_|gho_|sk-|xox[bap]-)[A-Za-z0-9_-]{16,}")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_IPV4 = re.compile(rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])")
_PHONE = re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![\w.+-])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![\w.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])")
_CARD = re.compile(r"(?<![0-9.+-])[0-9](?:[ -]?[0-9]){12,}")
_DIGIT_GROUP = re.compile(r"[0-9]+")
_VERSION_WORD = re.compile(r"(?i)\b(?:version|release|v|ver\.?)\s*$")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def _letters(*categories: str) -> str:
    """The letters of some Unicode categories as ranges of a character class."""
    codes = [c for c in range(0x2FFF) if unicodedata.category(chr(c)) in categories]
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k == len(codes) - 1 or codes[k + 1] != c + 1]
    return "".join(chr(b) if b == e else f"{chr(b)}-{chr(e)}" for b, e in zip(starts, ends, strict=True))


#: Capitals, and small letters with marks that combine with them, of all scripts that have both.
_UPPER, _LOWER = _letters("Lu", "Lt"), _letters("Ll", "Mn")
_PART = f"(?:[OD]['’])?[{_UPPER}][{_LOWER}]+(?:[{_UPPER}][{_LOWER}]+)*"
#: A whole word: no letter before or behind it.
_NAME = f"(?<![^\\W\\d_]){_PART}(?:['’-]{_PART})*(?![^\\W\\d_])"
_TITLE = "Mrs|Mr|Ms|Miss|Mx|Madam|Sir|Dr|Prof|Professor|Doctor|Rev|Herr|Frau|Monsieur|Madame|Mme|Mlle|Docteur|Professeur|Maître|Señora|Señor|Señorita|Sra|Sr|Srta|Doña|Doctora|Profesor|Profesora|Signor|Signora|Dott|Pani|Господин|Госпожа|Доктор|Профессор|Κύριος|Κυρία|Δρ"
#: What may stand between the parts of a name: particles and an initial.
_BETWEEN = f"[ \u00a0](?:(?:von|van|vom|de|da|di|du|del|della|der|den|dos|la|le|el|al|ten|ter|zu|zur)[ \u00a0])*(?:[{_UPPER}]\\.[ \u00a0])?"
#: Names in capitals count behind a title, and where the document has them as surnames elsewhere.
_CAPITAL_NAME = f"(?<![^\\W\\d_])[{_UPPER}]{{2,}}(?:['’-][{_UPPER}]{{2,}})*(?![^\\W\\d_])"
_EITHER = f"(?:{_NAME}|{_CAPITAL_NAME})"
_TITLED = re.compile(rf"\b(?:(?:{_TITLE})\b\.?[ \u00a0]+)+(?!(?:{_TITLE})\b)({_EITHER}(?:{_BETWEEN}{_EITHER}){{0,2}})")
_ONE_NAME, _ANY_NAME = re.compile(_NAME), re.compile(_EITHER)
_REST = re.compile(rf"(?:{_BETWEEN}{_NAME}){{1,2}}")

#: Given names by script and gender; a name is in one list only.
GIVEN = {
    ("latin", "f"): (
        "Alice Anna Barbara Carmen Caroline Charlotte Claire Elena Emily Emma Eva Hannah Isabel Jane Julia Laura Linda Lucia Maria Mary Michelle Nicole Petra Sarah Sofia Sophie Susan "
        "Abigail Ada Adele Adriana Agata Agnes Agnieszka Aisha Alejandra Aleksandra Alena Alexandra Alina Alison Amanda Amber Amelia Amélie Amina Amy Ana Anastasia Andrea Angela Angelika Angelina Anika Anita "
        "Anja Ann Anne Anneliese Annette Annie Antonia Ashley Astrid Audrey Aurélie Ava Barbora Beata Beatrice Beatriz Bernadette Beth Bettina Betty Beverly Bianca Birgit Blanca Bożena Brenda Brigitte "
        "Brittany Camila Camille Camilla Carla Carol Carolina Catalina Catherine Cécile Cecilia Céline Chantal Chiara Chloé Chloe Christa Christina Christine Cindy Clara Claudia Consuelo Corinne Cornelia "
        "Courtney Cristina Cynthia Dagmar Dana Daniela Danielle Danuta Deborah Debra Delphine Denise Diana Diane Dolores Donna Dora Doris Dorota Dorothy Edith Ekaterina Elaine Eleanor Eleonora Elisa "
        "Elisabeth Élise Elizabeth Ella Ellen Éloïse Elsa Emilia Émilie Erica Erika Erin Esmeralda Esther Eugenia Evelyn Ewa Fatima Fernanda Fiona Floriane Francesca Francisca Françoise Frieda Gabriela Gabriele "
        "Gail Geneviève Gertrud Gina Giovanna Gisela Giulia Gloria Grażyna Greta Gudrun Guadalupe Hana Hanna Heather Heidi Heike Helen Helena Hélène Helga Henrietta Hildegard Ilse Inés Ines Inga Ingeborg Ingrid "
        "Irena Irene Irina Irma Isabella Isabelle Ivana Iwona Jacqueline Jana Janet Janice Jasmine Jeanne Jennifer Jenny Jessica Jill Joan Joana Joanna Jolanta Josefa Josefina Josephine Joyce Juana Judith Judy "
        "Juliana Julie Juliette Justyna Jutta Karen Karin Karina Karolina Katarzyna Kate Katharina Katherine Kathleen Kathryn Kathy Katja Katrin Kayla Kelly Kimberly Kirsten Klara Krystyna Kristen Kristin "
        "Kristina Larissa Latisha Lauren Leah Léa Leila Lena Leonie Leslie Leticia Lidia Lieselotte Lilian Lillian Lisa Lise Liv Lorena Loretta Lori Louise Lucie Lucy Luisa Lydia Lynn Madeleine Madison Magda "
        "Magdalena Małgorzata Manon Manuela Marcela Margaret Margarita Margarete Margot Marguerite Mariana Marianne Marie Mariam Marilyn Marina Marion Marisol Marlene Marta Martha Martina Martine Mathilde Maureen "
        "Megan Melanie Melissa Mercedes Mia Mila Milena Mireille Miriam Molly Mónica Monica Monika Monique Nadia Nadine Nancy Naomi Natalia Natalie Nathalie Nina Nora Norma Odette Olga Olivia Pamela Patricia "
        "Paula Pauline Peggy Phyllis Pilar Priscilla Rachel Ramona Raquel Rebecca Regina Renata Renate Renée Rita Roberta Rocío Rosa Rosalie Rosemary Rosemarie Roxana Ruth Sabine Sabrina Samantha Sandra Sara "
        "Sharon Sheila Shirley Sigrid Silvia Simona Simone Solange Sonia Sonja Stacy Stefanie Stella Stephanie Susanne Suzanne Svetlana Sylvia Sylvie Tamara Tania Tanja Tatiana Teresa Thérèse Theresa Tiffany "
        "Tina Tracy Ulrike Ursula Uta Valentina Valeria Valérie Valerie Vanessa Vera Veronica Verónica Véronique Veronika Viktoria Virginie Vivian Viviane Waltraud Wanda Wendy Wilhelmina Xenia Ximena Yolanda "
        "Yvette Yvonne Zofia Zoe Zoé Zuzana"
    ).split(),
    ("latin", "m"): (
        "Alexander Andreas Antonio Carlos Charles Daniel David Diego Felix George Hans Henri James Jean John Jorge Lukas Martin Michael Miguel Paul Peter Pierre Robert Stefan Thomas William "
        "Aaron Abdul Adam Adrian Adrien Ahmed Alain Alan Albert Alberto Alejandro Aleksander Alessandro Alex Alexandre Alexei Alfonso Alfred Alfredo Ali Allan Álvaro Anders Andreu Andrés André Andrew Andrzej "
        "Andy Ángel Angelo Anthony Antoine Antonín Armando Arnaud Arnold Arthur Arturo Axel Barry Bartosz Benjamin Benoît Bernard Bernd Bertrand Björn Bogdan Boris Brandon Brian Bruce Bruno Bryan Carl Cédric César "
        "Christian Christoph Christophe Christopher Claude Clemens Cristian Craig Damian Damien Daniele Dariusz Dario Darren Dennis Derek Detlef Didier Dieter Dietmar Dimitri Dmitri Dominik Dominique Donald Douglas "
        "Dylan Eberhard Edgar Edmund Eduardo Edward Edwin Egon Emil Émile Emilio Emmanuel Enrico Enrique Eric Erich Erik Ernesto Étienne Ethan Eugene Eugenio Evan Ewald Fabian Fabien Fabio Federico Felipe Ferdinand "
        "Fernando Filip Florian Francesco Francis Francisco Franck François Franz Fred Frédéric Frederick Friedrich Fritz Gabriel Gareth Gary Gaspard Georg Georges Gérard Gerald Gerardo Gerd Gerhard Gilbert Gilles Giorgio "
        "Giovanni Giuseppe Gonzalo Gordon Grégory Gregory Grzegorz Guido Guillaume Guillermo Gunther Günter Günther Gustav Gustavo Hamid Harald Harold Harry Hassan Hector Héctor Heiko Heinrich Heinz Helmut Henrik Henry Herbert "
        "Hermann Horst Howard Hubert Hugo Hugues Ian Ibrahim Ignacio Igor Ismael Ivan Ivo Jack Jacek Jackson Jacob Jacques Jaime Jakob Jakub Jan Janusz Jaroslav Jarosław Jason Javier Jeffrey Jens Jeremy Jérôme Jeroen Jerry "
        "Jerzy Jesús Jiří Joachim Joaquín Joel Joe Johan Johann Johannes Jonas Jonathan José Josef Joseph Joshua Józef Juan Julien Julian Julio Jürgen Justin Kai Karl Karol Keith Kenneth Kevin Klaus Konrad Konstantin Kurt Kyle "
        "Larry Lars Laurent Lawrence Léo Leo Leon Leonard Leonardo Leopold Lothar Louis Luca Lucas Luc Luciano Ludwig Luigi Luis Łukasz Maciej Magnus Manfred Manuel Marc Marcel Marcelo Marcin Marco Marcos Marcus Marek Mario "
        "Marius Mark Markus Mateo Mateusz Mathias Mathieu Mats Matteo Matthew Matthias Maurice Mauricio Max Maxime Maximilian Mehmet Michał Michel Mikael Milan Miloš Mohamed Mohammed Muhammad Mustafa Nathan Nicholas Nicolas Nicolás Niels "
        "Nikolai Nils Noah Norbert Octavio Olaf Ole Oleg Oliver Olivier Omar Oscar Óscar Oskar Oswald Otto Pablo Pascal Patrice Patrick Patryk Pavel Paweł Pedro Per Petr Philip Philipp Philippe Phillip Piotr Quentin Rafael Rafał Rainer Ralf "
        "Ralph Ramón Ramon Randy Raphaël Raúl Raul Raymond Reinhard Rémi René Ricardo Richard Rodolfo Rodrigo Roger Roland Rolf Roman Ronald Rubén Rudolf Rüdiger Russell Ryan Salvador Samuel Santiago Scott Sebastian Sebastián Sébastien Sergei "
        "Sergio Siegfried Simon Sławomir Stanislav Stanisław Stéphane Stephan Stephen Steve Steven Sven Sylvain Tadeusz Terry Theodor Theodore Théo Thibault Thierry Thorsten Timothy Tobias Todd Tomás Tomasz Tomáš Tony Torsten Travis Tyler Udo "
        "Ulrich Uwe Václav Valentin Victor Vincent Vladimir Volker Walter Werner Wiesław Wilhelm Winfried Wojciech Wolfgang Xavier Yann Yannick Yusuf Yves Yuri Zachary Zbigniew Zdeněk"
    ).split(),
    ("cyrillic", "f"): "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия Александра Алина Алла Анастасия Антонина Валентина Валерия Вера Вероника Виктория Галина Дарья Евгения Елизавета Жанна Зинаида Зоя Инна Ксения Лариса Лидия Людмила Маргарита Марина Надежда Наталия Нина Оксана Полина Раиса Софья София Тамара".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей Юрий Анатолий Антон Аркадий Артём Богдан Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Владислав Вячеслав Геннадий Георгий Григорий Даниил Денис Евгений Егор Игорь Илья Кирилл Константин Леонид Максим Никита Олег Пётр Роман Руслан Станислав Степан Тимофей Фёдор Ярослав".split(),
    ("greek", "f"): "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Αγγελική Αικατερίνη Αλεξάνδρα Αναστασία Βασιλική Γεωργία Δήμητρα Ειρήνη Ευαγγελία Ευτυχία Θεοδώρα Κωνσταντίνα Παναγιώτα Παρασκευή Χριστίνα".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Παύλος Ανδρέας Αντώνης Απόστολος Βασίλης Γεώργιος Δημήτριος Ευάγγελος Θεόδωρος Ιωάννης Κωνσταντίνος Μιχάλης Νικόλαος Παναγιώτης Πέτρος Σπύρος Σταύρος Χρήστος".split(),
}
_GIVEN_OF = {name.lower(): (key, k) for key, names in GIVEN.items() for k, name in enumerate(names)}


def _plain(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))


#: Listed names by their letters without accents; one without any comes first.
_GIVEN_PLAIN = {_plain(name): name for name in sorted(_GIVEN_OF, key=lambda n: (n == _plain(n), n))}
#: Letters that may stand for each other: vowels and consonants of each script.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåæéèêëíìîïóòôöõøúùûüąāăęėēěįīıőōūůűų", "çñßýÿðþćčďđğģķļľłńňņřŕśšşșťţțźżž", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "άέήίόύώ"]
_CLASS_OF = {c: group for group in CLASSES for c in group}
_DIGITS, _LETTERS, _CAPITALS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PUBLIC = [str(k) for k in range(1, 224) if k not in (10, 100, 127, 169, 172, 192, 198, 203)]
_OCTETS = [str(k) for k in range(256)]
_HOSTS = [str(k) for k in range(1, 255)]
FREE_MAIL = {"gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "gmx.de", "web.de", "orange.fr", "proton.me"}
_SECOND_LEVEL = {"co", "com", "org", "net", "ac", "gov"}


class Permutation:
    """A keyed permutation of 0..n-1 that moves every number."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.bits = n, max(2, (n - 1).bit_length() + (n - 1).bit_length() % 2)
        self.half = self.bits // 2
        self.mask = (1 << self.half) - 1
        self.seed = hashlib.blake2b(tweak.encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()

    def _round(self, k: int, x: int) -> int:
        size = (self.half + 7) // 8
        data = hashlib.blake2b(bytes([k]) + x.to_bytes(size, "little"), key=self.seed, digest_size=min(64, size + 1)).digest()
        return int.from_bytes(data, "little") & self.mask

    def _there(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for k in range(6):
                left, right = right, left ^ self._round(k, right)
            x = left << self.half | right
            if x < self.n:
                return x

    def _back(self, x: int) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for k in reversed(range(6)):
                left, right = right ^ self._round(k, left), left
            x = left << self.half | right
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return self._back((self._there(x) + 1) % self.n) if self.n > 1 else x


def session_key(spark: SparkSession) -> bytes:
    """The key of the session: its setting, or a random one that the session keeps."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found.encode()


def permute(key: bytes, tweak: str, parts: list[tuple[str, list[str] | str]]) -> str | None:
    """Replace each part by one of its choices; None if there is nothing to choose from."""
    n, index = 1, 0
    for value, choices in parts:
        if len(choices) > 1:
            index += n * choices.index(value)
            n *= len(choices)
    if n < 2:
        return None
    # The choices are the shape: values of one shape are permuted among themselves.
    shape = "\0".join("".join(choices) if len(choices) < 60 else f"#{len(choices)}" for _, choices in parts)
    index, out = Permutation(key, f"{tweak}\1{shape}", n)(index), []
    for value, choices in parts:
        if len(choices) > 1:
            index, k = divmod(index, len(choices))
            out.append(choices[k])
        else:
            out.append(value)
    return "".join(out)


def _characters(text: str) -> list[tuple[str, str]]:
    """Each character with the characters that may stand for it."""
    return [(c, _DIGITS if c in _DIGITS else _LETTERS if c in _LETTERS else _CAPITALS if c in _CAPITALS else c) for c in text]


def _check_digit(digits: str) -> int:
    """The digit that makes digits + it valid (Luhn)."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return -total % 10


def is_card(digits: str) -> bool:
    return len(digits) == 16 or 13 <= len(digits) <= 19 and _check_digit(digits[:-1]) == int(digits[-1])


def _cards(run: str) -> list[tuple[int, int, str]]:
    """Begin, end and digits of the cards in a run of groups of digits, the likeliest first; they may overlap.

    The whole run is tried first; then each part of up to five groups. A valid check digit counts before the
    length alone, and the groups of printed cards (one, 4-4-4-4, 4-6-5) before any others.
    """
    groups = [(m.start(), m.end()) for m in _DIGIT_GROUP.finditer(run)]
    whole = "".join(run[b:e] for b, e in groups)
    if is_card(whole):
        return [(0, len(run), whole)]
    found = []
    for i in range(len(groups)):
        for j in range(i, min(i + 5, len(groups))):
            digits = "".join(run[b:e] for b, e in groups[i : j + 1])
            if is_card(digits):
                valid = _check_digit(digits[:-1]) == int(digits[-1]) and digits[0] in "23456"
                printed = i == j or [e - b for b, e in groups[i : j + 1]] in ([4, 4, 4, 4], [4, 6, 5])
                if valid or printed:
                    found.append((2 * (not printed) + (not valid), -len(digits), groups[i][0], groups[j][1], digits))
    return [x[2:] for x in sorted(found)]


@dataclass(frozen=True)
class Entity:
    kind: str
    begin: int
    end: int
    #: What makes two mentions the same.
    value: str


def _fresh(kind: str, value: str, key: bytes, attempt: int) -> str:
    """The surrogate of a normalised value."""
    tweak = f"{kind}\1{attempt}"
    found = None
    if kind == "email":
        local, _, domain = value.rpartition("@")
        if domain not in FREE_MAIL:
            labels = domain.split(".")
            fixed = 2 if len(labels) > 2 and labels[-2] in _SECOND_LEVEL and len(labels[-1]) == 2 else 1
            head = ".".join(labels[:-fixed])
            new_domain = (permute(key, f"{tweak}\1domain", _characters(head)) or head) + "." + ".".join(labels[-fixed:])
        else:
            new_domain = domain
        new_local = permute(key, f"{tweak}\1{domain}", _characters(local)) or local
        found = f"{new_local}@{new_domain}"
    elif kind == "ipv4":
        parts = value.split(".")
        if parts[0] in _PUBLIC:
            choices = [_PUBLIC, _OCTETS, _OCTETS]
        elif parts[0] == "192" and parts[1] == "168" or parts[0] == "172" or parts[0] not in ("10", "127"):
            choices = [[parts[0]], [parts[1]], _OCTETS]
        else:
            choices = [[parts[0]], _OCTETS, _OCTETS]
        choices.append(_HOSTS if parts[3] in _HOSTS else ["0", "255"])
        found = permute(key, tweak, [x for pair in zip(parts, choices, strict=True) for x in (pair, (".", "."))][:-1])
    elif kind == "card":
        body = permute(key, tweak, [(value[0], value[0]), *[(d, _DIGITS) for d in value[1:-1]]])
        off = (int(value[-1]) - _check_digit(value[:-1])) % 10
        found = body + str((_check_digit(body) + off) % 10)
    elif kind in ("phone", "ssn"):
        country, _, digits = value.rpartition("+")
        lead = {0, 3} if kind == "phone" and len(digits) == 10 else {0}
        found = permute(key, f"{tweak}\1{country}", [(d, ("23456789" if d in "23456789" else "01") if k in lead else _DIGITS) for k, d in enumerate(digits)])
        found = f"{country}+{found}" if found and "+" in value else found
    elif kind == "given":
        script, gender = (_GIVEN_OF.get(value) or (("", ""), 0))[0]
        names = GIVEN[script, gender]
        order = sorted(range(len(names)), key=lambda k: hashlib.blake2b(names[k].encode(), key=hashlib.sha256(key).digest()[:32], salt=str(attempt).encode()[:16]).digest())
        return names[order[(order.index(_GIVEN_OF[value][1]) + 1) % len(order)]].lower()
    elif kind == "name":
        found = permute(key, tweak, [(c, _CLASS_OF.get(c, c)) for c in value])
    elif kind == "iban":
        body = permute(key, tweak, _characters(value[4:])) or value[4:]
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        found = f"{value[:2]}{98 - rest:02d}{body}"
    elif kind == "access_key":
        found = value[:4] + (permute(key, tweak, _characters(value[4:])) or "")
    elif set(value) <= set("0123456789abcdef"):
        found = permute(key, tweak, [(c, "0123456789abcdef") for c in value])
    elif set(value) <= set("0123456789ABCDEF"):
        found = permute(key, tweak, [(c, "0123456789ABCDEF") for c in value])
    else:
        found = permute(key, tweak, _characters(value))
    if found is None or found == value:
        found = hashlib.blake2b(f"{tweak}\1{value}".encode(), key=hashlib.sha256(key).digest(), digest_size=8).hexdigest()
    return found


def _case_like(surrogate: str, original: str) -> str:
    """Letter case and length as the original has them."""
    if original.isupper():
        return surrogate.upper()
    return "".join(s.upper() if o.isupper() else s for s, o in zip(surrogate, original, strict=True)) if len(surrogate) == len(original) else surrogate.capitalize() if original[:1].isupper() else surrogate


def _render(entity: Entity, original: str, surrogate: str) -> str:
    """The surrogate in the notation and the digits of this mention."""
    new = _in_notation(entity, original, surrogate)
    other = None if original.isascii() else _OTHER_DIGIT.search(original)
    if other:
        zero = ord(other[0]) - unicodedata.decimal(other[0])
        new = "".join(chr(zero + int(c)) if c in _DIGITS else c for c in new)
    return new


def _in_notation(entity: Entity, original: str, surrogate: str) -> str:
    if entity.kind == "ipv4":
        return ".".join(n.zfill(len(o)) if o[0] == "0" or not o.isascii() else n for o, n in zip(original.split("."), surrogate.split("."), strict=True))
    if entity.kind in ("card", "ssn", "phone", "iban"):
        new = surrogate.rpartition("+")[2]
        digits = iter(new)
        skip = len([c for c in original if c.isalnum()]) - len(new)
        out = []
        for c in original:
            if c.isalnum() and skip > 0:
                out.append(c)
                skip -= 1
            else:
                out.append(next(digits, c) if c.isalnum() else c)
        return "".join(out)
    if entity.kind in ("email", "given", "name"):
        return _case_like(surrogate, original)
    return surrogate


def _phone_value(text: str) -> str | None:
    digits = "".join(c for c in text if c in _DIGITS)
    if not 7 <= len(digits) <= 15:
        return None
    if text.startswith("+"):
        country = re.match(r"\+([0-9]{1,3}?)(?=[ .(-]|[0-9]{10}$|$)", text)
        head = country[1] if country else digits[:1]
        national = digits[len(head) :]
        return national if head == "1" and len(national) == 10 else f"{head}+{national}"
    return digits


def detect(text: str) -> list[Entity]:
    """The entities of a text, in order and without overlaps."""
    found: list[Entity] = []
    begins: list[int] = []
    ends: list[int] = []
    if not text.isascii():
        text = _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)

    def add(kind: str, begin: int, end: int, value: str) -> None:
        at = bisect_right(begins, begin)
        if (not at or ends[at - 1] <= begin) and (at == len(begins) or end <= begins[at]):
            begins.insert(at, begin)
            ends.insert(at, end)
            found.append(Entity(kind, begin, end, value))

    low = text.lower() if any(c in text for c in "=:") else ""
    if low and any(w in low for w in ("token", "passw", "passphrase", "pwd", "secret", "key")):
        for m in _SECRET.finditer(text):
            if m["word"] or any(c in _DIGITS for c in m["value"]):
                add("secret", m.start("value"), m.end("value"), m["value"])
    if "AKIA" in text or "ASIA" in text:
        for m in _ACCESS_KEY.finditer(text):
            add("access_key", m.start(), m.end(), m[0])
    if "_" in text or "-" in text:
        for m in _KEY_PREFIX.finditer(text) if any(p in text for p in ("ghp_", "gho_", "sk-", "xox")) else ():
            add("secret", m.start(), m.end(), m[0])
    if "@" in text:
        for begin, end in _emails(text):
            add("email", begin, end, text[begin:end].lower())
    if _ANY_DIGITS.search(text):
        for m in _IPV4.finditer(text):
            if not _VERSION_WORD.search(text[max(0, m.start() - 40) : m.start()]):
                add("ipv4", m.start(), m.end(), ".".join(str(int(part)) for part in m[0].split(".")))
        for m in _IBAN.finditer(text):
            value = m[0].replace(" ", "")
            if 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
                add("iban", m.start(), m.end(), value)
        for m in _SSN.finditer(text):
            add("ssn", m.start(), m.end(), m[0].replace("-", ""))
        for m in _PHONE.finditer(text):
            if value := _phone_value(m[0]):
                add("phone", m.start(), m.end(), value)
        for m in _CARD.finditer(text):
            for begin, end, digits in _cards(m[0]):
                add("card", m.start() + begin, m.start() + end, digits)
    people = _people(text)
    if people:
        for begin, end, kind in people:
            add(kind, begin, end, _given_value(text[begin:end]) or "" if kind == "given" else text[begin:end].lower())
        # All other mentions of these people in the document, also by the surname or the given name alone.
        surnames = {e.value for e in found if e.kind == "name"}
        given = {e.value for e in found if e.kind == "given"}
        for m in _ANY_NAME.finditer(text):
            if m[0].lower() in surnames:
                add("name", m.start(), m.end(), m[0].lower())
            elif (value := _given_value(m[0])) in given:
                add("given", m.start(), m.end(), value)
    return sorted(found, key=lambda e: e.begin)


_ANY_DIGITS = re.compile(r"[0-9][0-9 .()-]{5}")


_OTHER_DIGIT = re.compile(r"[^\D0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of e-mail addresses, sought from each @ outwards: no character is looked at more than a few times."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        while begin < at and text[begin] in "._%+'-":
            begin += 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield begin, done
        at = text.find("@", done)


def _given_value(name: str) -> str | None:
    """The listed given name that this is, also if only the accents differ."""
    low = name.lower()
    if low in _GIVEN_OF or low.isascii():
        return low if low in _GIVEN_OF else None
    return _GIVEN_PLAIN.get(_plain(low))


def _is_given(name: str) -> bool:
    """A listed given name, or some with hyphens between them."""
    return bool(_given_value(name)) or "-" in name and all(_given_value(part) for part in name.split("-"))


def _people(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and kind of the words of names: after a title, or a known given name before capitalised words."""
    out = []

    def words(begin: int, end: int) -> None:
        parts = list(_ANY_NAME.finditer(text, begin, end))
        for k, part in enumerate(parts):
            kind = "given" if k < len(parts) - 1 and _given_value(part[0]) else "name"
            out.append((part.start(), part.end(), kind))

    for m in _TITLED.finditer(text):
        words(m.start(1), m.end(1))
    done = 0
    for m in _ONE_NAME.finditer(text):
        if m.start() >= done and _is_given(m[0]) and (rest := _REST.match(text, m.end())):
            done = rest.end()
            words(m.start(), done)
    return out


def rewrite(text: str, key: bytes, attempts: dict[bytes, int]) -> tuple[str, int]:
    """The text with surrogates, and the number of entities."""
    entities = detect(text)
    if not entities:
        return text, 0
    out, at = [], 0
    for e in entities:
        original = text[e.begin : e.end]
        out += [text[at : e.begin], _render(e, original, _fresh(e.kind, e.value, key, attempts.get(_digest(key, e.kind, e.value), 0) if attempts else 0))]
        at = e.end
    return "".join([*out, text[at:]]), len(entities)


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, begin, end (code points), value for every mention."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, e) for k, t in enumerate(batch.column(1).to_pylist()) if t for e in detect(t)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([k for k, _ in rows], pa.int64())), pa.array([e.kind for _, e in rows], pa.string()), pa.array([e.begin for _, e in rows], pa.int64()), pa.array([e.end for _, e in rows], pa.int64()), pa.array([e.value for _, e in rows], pa.string())],
                ["doc_id", "kind", "begin", "end", "value"],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(found, f"doc_id {kind}, kind string, begin long, end long, value string")


def _digest(key: bytes, kind: str, value: str) -> bytes:
    """What stands for a value in stored tables."""
    return hashlib.blake2b(f"{kind}\1{value}".encode(), key=hashlib.sha256(key).digest(), digest_size=16, person=b"ledger").digest()


def ledger(docs: DataFrame, key: bytes, text_col: str = "text", draw: Callable[[str, str, bytes, int], str] = _fresh) -> DataFrame:
    """kind, value, attempt, surrogate of every distinct entity, both as keyed digests; surrogates are distinct within a kind.

    Where surrogates meet, all values but one are drawn anew from the texts, which alone hold them.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    schema = "kind string, value binary, attempt int, surrogate binary"

    def drawn(attempts: dict[bytes, int] | None) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(attempts)

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen = shared.value
            for batch in batches:
                known = {(e.kind, e.value) for t in batch.column(0).to_pylist() if t for e in detect(t)}
                rows = [(k, v, _digest(key, k, v)) for k, v in sorted(known)]
                rows = [(k, d, a, _digest(key, k, draw(k, v, key, a))) for k, v, d in rows if (a := 0 if chosen is None else chosen.get(d, -1)) >= 0]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate((pa.string(), pa.binary(), pa.int32(), pa.binary()))], ["kind", "value", "attempt", "surrogate"])

        return texts.mapInArrow(rows_of, schema).distinct()

    table = materialize(drawn(None), "ledger")
    while True:
        met = table.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("value").alias("first")).filter("n > 1")
        met = materialize(met, "met")
        if met.isEmpty():
            return table
        again = table.join(met.hint("merge"), ["kind", "surrogate"]).filter(F.col("value") != F.col("first"))
        again = materialize(again.select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "again")
        stay = table.join(again.select("kind", "value").hint("merge"), ["kind", "value"], "left_anti")
        table = materialize(stay.unionByName(drawn(_attempts(again))), "ledger")


def _attempts(table: DataFrame) -> dict[bytes, int]:
    """The entities that were drawn more than once. Keyed permutations leave only hashes of 64 bits to meet."""
    rows = table.filter("attempt > 0").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("more repeated draws than a 64-bit hash can explain: is the key in use?")
    return {bytes(r["value"]): r["attempt"] for r in rows}


def replace(docs: DataFrame, key: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with surrogates), n_entities for every document. Without a key, the session's is used."""
    key = key or session_key(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_attempts(ledger(docs, key, text_col)))

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [(t, 0) if not t else rewrite(t, key, shared.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in new], pa.string()), pa.array([n for _, n in new], pa.int64())], ["doc_id", "text", "n_entities"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rewritten, f"doc_id {kind}, text string, n_entities long")


def replace_in(docs: DataFrame, key: bytes | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All columns of `docs`, with surrogates in the text and its length brought up to date."""
    key = key or session_key(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_attempts(ledger(docs, key, text_col)))
    at = docs.columns.index(text_col)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([t if not t else rewrite(t, key, shared.value)[0] for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    out = plain.mapInArrow(rewritten, plain.schema).toDF(*docs.columns)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out

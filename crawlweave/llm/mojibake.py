"""Garbled text from wrong character encodings (problem 10).

For every pair (encoding of the bytes, encoding they were read with) the garbled form of each letter, sign or
frequent pair of letters is computed beforehand and put into one multi-pattern automaton. Matches are replaced where
they stand; what surrounds them, correct accents included, is left alone.

Two kinds of pairs: UTF-8 read as a single-byte encoding garbles each character into its own sequence of 2 to 4
(those of other symbols and scripts follow from the classes of lead and continuation bytes);
one single-byte encoding read as another maps letters to letters, so there the share of a language's frequent
letter pairs (Cyrillic) or triples with an accent (western) decides, sentence by sentence, against the share in the text as it stands.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.llm import prose

# Frequent letter pairs of Ukrainian beside those, and of Greek.
UKRAINIAN = "ні ті ві рі лі мі ді сі пі бі кі зі ін ік ів ід із іс іт їн їх єт єм ює ії ою ую ають ську ський ьк цьк йс".split()
GREEK = "ου αι το ει τη ον ιν αν να στ τα εν ρο τι κα τε ατ νο σε με πο ης ος ας ια απ ερ ετ υν δε αρ λο μα ντ ικ λε ρα θα μο πα οι σα γι ισ μέ ού ασ ησ υτ τό ίν αυ πλ νι κό κε είμ ιμ εν απ βά στ ηκ λά θο ολ ογ στή ής".split()
# Single-byte encodings of Greek text.
GREEK_IN = "cp1253 iso8859-7".split()
# Single-byte encodings of Central European text.
CENTRAL = "cp1250 iso8859-2".split()
# Encodings UTF-8 bytes are read with by mistake.
READ_AS = "cp1252 latin-1 cp1250 iso8859-2 cp1251 koi8-r cp866 mac_cyrillic mac_roman cp437 cp850 cp1254 iso8859-15 cp1253 cp1257".split()
# Single-byte encodings of Cyrillic text, and what they are read as besides each other.
CYRILLIC = "cp1251 koi8-r cp866 mac_cyrillic iso8859-5".split()
LATIN_READERS = "cp1252 latin-1 mac_roman cp437 cp850 cp1250".split()
# Single-byte encodings of western text.
WESTERN = "cp1252 cp850 cp437 mac_roman".split()
WESTERN_READERS = "cp1252 cp850 cp437 mac_roman cp1251 koi8-r cp866 cp1250 cp1253".split()
# Frequent letter pairs of Russian.
PAIRS = (
    "ст но то на ен ов ни ра во ко по ро не ал ос ет ли го ка пр ер та от ом ре ор од ог ва ло ел ит ол за ат ть ри ны ем ан ла де ле ми до"
    " ть ск те ес ве ис се сь ик ой ый ий ие ия ам ям ах их ых ым им ше ще че чт об от пи ша да ди ту ду ру ну му ки ке"
).split()
# Letters with accents that stand inside words of western languages.
ACCENTS = "éèêëàâáäãåçñîïíìôöóòõùûúüßœæøÉÈÀÇÑÖÜÄÓÁÍÚ"
# Frequent words with accents; their letter triples, word edges included, tell garbled western text.
WORDS = {
    "de": "für über können möglich müssen natürlich während würde wäre hätte größe größer große straße weiß heißt schließen schön grüße zurück stück übersicht überblick später nächste erklären ändern änderung anhänge anhänger verfügbar gültig ungültig löschen öffnen hinzufügen ausgewählt auswählen wählen zählen länge länder häufig fähig tätig täglich jährlich persönlich höhe hören gehört böse lösung größte fünf frühling früher führen grün gemäß außer außerdem maß spaß fuß schlüssel tür büro bücher prüfen einführung unterstützt benötigt geöffnet erhöhen völlig wörter mädchen käufer verkäufer geschäft qualität universität realität gebäude bäume träume räume ärger ähnlich ämter älter äußern öl österreich übung übrig müde süß kürzlich künftig rückgabe glück brücke lücke dünn schützen stützen nützlich nötig gewöhnlich königlich",
    "fr": "été être même après très déjà voilà là où à élève école équipe étude état éviter écrire numéro général généralement sécurité société qualité université activité réalité priorité clé clés créer créé créée année journée idée entrée durée résumé résultat réponse répondre réservé réseau détail détails développer déplacer début dépôt élément élémentaire modèle problème système thème père mère frère première dernière manière matière lumière règle siècle pièce vérifier vérité préféré préférer présent présenter prévu français française leçon façon garçon reçu ça commençons fenêtre fête tête forêt intérêt arrêter prêt bientôt côté hôtel contrôle rôle tôt plutôt dû sûr sûre août goût coût connaître paraître boîte île maîtriser naître noël maïs naïf haïr supérieur intérieur extérieur médical matériel mélange célèbre événement légal légère théâtre âge bâtiment tâche château pâte grâce drôle dès accès succès progrès près exprès auprès français café marché privé publié modifié terminé vidéo",
    "es": "está están más también así después según aquí allí además página página número números teléfono cómo qué quién cuándo dónde sólo día días todavía mañana año años niño niña señor señora español española pequeño pequeña compañía contraseña diseño enseñar añadir baño sueño tamaño información sección acción opción función sesión versión situación educación dirección atención canción razón corazón televisión menú único última último útil fácil difícil rápido rápida médico público pública música política república económico artículo título vehículo país raíz maíz café bebé sofá mamá papá será hará podrá tendrá dirá allá jamás detrás través francés inglés interés mes árbol área ángel éxito época índice sí mí tú él sé dé té avión camión jardín catálogo diálogo código método período básico clásico práctica técnico histórico vergüenza pingüino cigüeña",
    "pl": "się że być może też więc już są będzie będą może można proszę każdy każda każde który która które którzy również także ponieważ żeby człowiek mężczyzna dziękuję książka książki godność miłość wartość możliwość większość ilość część części cześć wiadomość treść źródło źródła źle łódź łatwo łącznie połączenie wyłącznie główna główny główne stały stała małe mały była było były miał miała chciał chciała dał mógł mogą mówi mówić późno później wcześniej dzień dziś dzięki gdzież jeśli jeżeli cię mię imię pięć dziesięć sześć dziewięć tysiąc miesiąc ząb rąk ręka ręce święto świat światło śnieg środa środek wśród oś góra góry górny król królowa sól ból wóz żona życie życzenia żółty żółć żaden dużo duży różne różny róża gęś jaźń koń końca końcu dłoń cień słońce słowo słów ćwiczenie zażyć pomylić przecież zgłoś zgłoszenie hasło hasła użytkownik użytkownika użycie ścieżka ściana łóżko żądanie błąd błędy błędu zarządzanie własny własność".replace("  ", " "),
    "pt": "não são está estão também então até já só você vocês três mês português portuguesa inglês francês após através atrás ação ações informação informações atenção função opção opções versão sessão seção situação educação direção inscrição descrição solução questão razão coração mão mãe pão irmão irmã manhã amanhã avião João põe põem ações anões lições serviço serviços preço preços começar começo força cabeça criança espaço março açúcar página número números último última único útil fácil difícil rápido público pública música política república história memória série notícia início próprio próxima próximo médico código catálogo método período básico prática técnico histórico é às à àquele avó avô robô café pé fé será fará terá dirá lá cá será há país saída saúde conteúdo usuário usuários endereço português família família experiência ciência agência importância distância câmera ângulo âmbito você bebê ênfase êxito gêmeo índice área água águas",
}
#: Signs of correct text that garbled ones are read back to.
WRITTEN = frozenset("‘’“”«»–—…€œŒ")
#: Signs that correct text writes beside a word.
BESIDE = frozenset("‘’“”„‚‹›«»–—…•€™†‡°©®§·¡¿\xa0\xad")
#: Of these, what stands inside a word too.
WITHIN = frozenset("’‘–—…·\xa0\xad")
SIGNS = "‘’“”„‚‹›«»–—…•€™†‡‰¡¿£¥¢§°ºª©®±²³¹µ¶·¼½¾×÷№ ­​‎﻿ −≤≥"
CONT_SIGNS = set("©®¢£¤¥¦§¨ª¬±²³¶¹º¼½¾¡¿°µ¯´¸·")


def _decode(data: bytes, enc: str) -> str | None:
    """As browsers do: bytes without a character become C1 controls."""
    try:
        return data.decode(enc)
    except UnicodeDecodeError:
        if enc.startswith("cp125"):
            return "".join(_one(b, enc) for b in data)
        return None


def _one(b: int, enc: str) -> str:
    try:
        return bytes([b]).decode(enc)
    except UnicodeDecodeError:
        return chr(b)


def _alphabet() -> list[str]:
    """Every letter and mark that UTF-8 writes with two bytes, and the signs."""
    return [chr(c) for c in range(0x80, 0x800) if c < 0xA0 or unicodedata.category(chr(c)) != "Cn"] + list(SIGNS)


def _usual(c: str) -> bool:
    """Latin, Greek and Cyrillic letters and signs."""
    return c < "ƀ" or c in "ƒˆ˜Ґґ" or "Ά" <= c <= "ώ" or "Ѐ" <= c <= "џ" or c in SIGNS


# Signs that stand after letters in correct text.
ORDINARY = frozenset("\xa0\xad…–—‘’“”„‚«»‹›•·°©®™§№€£")


def _classes() -> tuple[dict[str, dict[str, int]], re.Pattern]:
    """Per reader its characters of the bytes 80-F4, and what starts a UTF-8 sequence of three or four bytes in any of them."""
    of: dict[str, dict[str, int]] = {}
    lead, cont = set(), set()
    for enc in READ_AS:
        chars = {g: b for b in range(0x80, 0xF5) if (g := _decode(bytes([b]), enc))}
        of[enc] = chars
        lead |= {g for g, b in chars.items() if b >= 0xE0}
        cont |= {g for g, b in chars.items() if b < 0xC0}
    some = lambda s: "[" + "".join(map(re.escape, sorted(s))) + "]"
    # Three lower-case Cyrillic letters are a word, not a sequence.
    return of, re.compile(f"(?![а-яё]{{3}})(?={some(lead)}{some(cont)}{{2}})")


@lru_cache(1 << 16)
def _sequences(four: str) -> list[tuple[int, dict[str, str]]]:
    """[(length, {reader: character})] of the sequences at the start of these four characters."""
    found: dict[int, dict[str, str]] = {}
    for enc, chars in automaton().bytes_of.items():
        lead = chars.get(four[0], 0)
        if lead < 0xE0:
            continue
        n = 3 if lead < 0xF0 else 4
        data = [chars.get(c, 0) for c in four[:n]]
        try:
            c = bytes(data).decode("utf-8") if len(data) == n else ""
        except UnicodeDecodeError:
            continue
        if len(c) == 1 and unicodedata.category(c) not in ("Cn", "Co", "Cs", "Cc") and not "⠀" <= c <= "⣿":
            found.setdefault(n, {})[enc] = c
    return list(found.items())


def _by_rule(text: str) -> list[tuple[int, int, dict[str, str]]]:
    """Sequences that some reader turns back into one character of three or four UTF-8 bytes: (start, end, {reader: character}).

    Symbols and four-byte characters stand for themselves; letters and marks only beside another sequence of the reader,
    and nothing that correct text writes: a letter with quotes, dots or dashes after it.
    """
    found = {}
    for m in automaton().start.finditer(text):
        for n, by in _sequences(text[m.start() : m.start() + 4]):
            found[m.start(), m.start() + n] = by
    if not found:
        return []
    out = []
    if any(_cyrillic(text[a]) for a, _ in found) and _segments(text)[1]:  # its letters make such sequences by chance
        found = {k: by for k, by in found.items() if not _cyrillic(text[k[0]])}
    begins, ends = {a for a, _ in found}, {b for _, b in found}
    for (a, b), by in found.items():
        seq, before = text[a:b], text[a - 1] if a else " "
        mixed = not seq.isalpha() or any(x.islower() and y.isupper() for x, y in zip(seq, seq[1:])) or seq[:2] == "ЁЯ" or "Ͱ" <= seq[0] < "Ѐ" and not "Ͱ" <= seq[1] < "Ѐ"
        plain = all(c in ORDINARY for c in seq[1:]) and (seq[0] != "â" or before.isalpha())
        beside = a in ends or b in begins
        if (not mixed or plain) and not beside:
            continue
        sure = {} if not mixed or plain else {e: c for e, c in by.items() if len(seq) == 4 or unicodedata.category(c)[0] == "S"}
        side = {e for (x, y), other in found.items() if y == a or x == b for e in other} if beside and len(sure) < len(by) else set()
        keep = sure | {e: c for e, c in by.items() if e in side}
        if keep:
            out.append((a, b, keep))
    return sorted(out, key=lambda x: (x[0], -x[1]))


class Automaton:
    """Built once a worker. `multi`: garbled sequence -> {reader: character}; `pairs`: letters -> [(bytes in, read as)]."""

    def __init__(self) -> None:
        multi: dict[str, dict[str, str]] = {}
        for c in _alphabet():
            for enc in READ_AS:
                g = _decode(c.encode("utf-8"), enc)
                if g and len(g) > 1 and g != c:
                    multi.setdefault(g, {}).setdefault(enc, c)
        multi.setdefault("â€", {})["cp1252"] = "”"
        #: sequences of rarer scripts: taken only beside another sequence of the reader
        rare = {g for g, by in multi.items() if not any(_usual(c) for c in by.values())}
        self.bytes_of, self.start = _classes()
        self.multi = ahocorasick.Automaton()
        for g, by in multi.items():
            self.multi.add_word(g, (len(g), by, g in rare))
        self.multi.make_automaton()
        letters: dict[str, set] = {}
        for pairs, trues, readers in ((PAIRS + UKRAINIAN, CYRILLIC, CYRILLIC + LATIN_READERS + ["cp1253"]), (GREEK, GREEK_IN, GREEK_IN + LATIN_READERS + CYRILLIC)):
            for p in dict.fromkeys(pairs):
                letters.setdefault(p.upper(), set()).add(("", "upper"))
                for form in (p, p.title()):
                    letters.setdefault(form, set()).add(("", ""))
                    for true in trues:
                        try:
                            data = form.encode(true)
                        except UnicodeEncodeError:
                            continue
                        for enc in readers:
                            g = _decode(data, enc) if enc != true else None
                            if g and g != form:
                                letters.setdefault(g, set()).add((true, enc))
        self.pairs = ahocorasick.Automaton()
        for g, by in letters.items():
            kind = 1 if ("", "") in by else 2 if ("", "upper") in by else 0
            self.pairs.add_word(g, (kind, tuple(p for p in sorted(by) if p[0])))
        self.pairs.make_automaton()
        self.triples, self.garbled_triples, self.letters = _western_table()
        #: a garbled accent: a foreign letter, capital or box sign, which can't stand inside a lower-case Latin word
        self.western: dict[str, list[tuple[str, str, str]]] = {}
        for c in ACCENTS:
            for true in WESTERN:
                for enc in WESTERN_READERS:
                    try:
                        g = c.encode(true).decode(enc)
                    except UnicodeError:
                        continue
                    if enc != true and g != c and not g.isascii() and g not in SIGNS and (g.isupper() or g.isalpha() and g > "Ͱ" or g > "∀"):
                        self.western.setdefault(g, []).append((true, enc, c))


def _triples(word: str) -> list[str]:
    """Each letter with an accent between its neighbours; a space is the edge of the word."""
    w = f" {word} "
    return [w[k - 1 : k + 2] for k in range(1, len(w) - 1) if not w[k].isascii()]


def _western_table() -> tuple[dict[str, set[str]], dict[str, list[tuple[str, str, str, str]]], dict[str, frozenset[str]]]:
    """(triple -> languages), (garbled triple -> [(bytes in, read as, language, letter)]), (language -> its letters)."""
    plain: dict[str, set[str]] = {}
    for lang, words in WORDS.items():
        for w in words.split():
            for form in (w, w.capitalize(), w.upper()):
                for t in _triples(form):
                    plain.setdefault(t, set()).add(lang)
    table: dict[str, list[tuple[str, str, str, str]]] = {}
    for t, langs in plain.items():
        for true in WESTERN if langs - {"pl"} else CENTRAL:
            try:
                data = t.encode(true)
            except UnicodeEncodeError:
                continue
            for enc in dict.fromkeys([*WESTERN_READERS, *READ_AS]):
                g = _decode(data, enc) if enc != true else None
                if g and g[1] != t[1] and not g[1].isascii() and g not in plain and re.search("[A-Za-z]", g):
                    table.setdefault(g, []).extend((true, enc, lang, t[1]) for lang in langs)
    letters = {lang: frozenset(c for w in words.split() for c in w + w.upper() if not c.isascii()) for lang, words in WORDS.items()}
    return plain, table, letters


_built: list[Automaton] = []


def automaton() -> Automaton:
    if not _built:
        _built.append(Automaton())
    return _built[0]


def _matches(text: str) -> list[tuple[int, int, dict[str, str]]]:
    """Leftmost-longest matches of the multi-character garbles: (start, end, {reader: character})."""
    got = [(end - n + 1, end + 1, by, rare) for end, (n, by, rare) in automaton().multi.iter_long(text)]
    listed = []
    for k, (a, b, by, rare) in enumerate(got):
        if rare and not any(0 <= j < len(got) and (got[j][1] == a or got[j][0] == b) and not by.keys().isdisjoint(got[j][2]) for j in (k - 1, k + 1)):
            continue
        listed.append((a, b, by))
    rule = _by_rule(text)
    if not rule:
        return listed
    out: list[tuple[int, int, dict[str, str]]] = []
    for a, b, by in sorted([*listed, *rule], key=lambda x: (x[0], -x[1])):
        if out and (a, b) == out[-1][:2]:
            out[-1] = (a, b, by | out[-1][2])
        elif not out or a >= out[-1][1]:
            out.append((a, b, by))
    return out


def _strong(text: str, a: int, b: int) -> bool:
    """Whether this match can't well be correct text."""
    x, y = text[a], text[b - 1]
    before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    if b - a >= 3:
        return not (text[a:b].isalpha() and text[a:b].isascii())
    if x.isalpha():
        if y.isalpha():  # two letters: only if no word holds them so: a capital inside a word
            first = a < 2 or not text[a - 2].isalpha()
            return x.isupper() and not _cyrillic(x) and (before.islower() or before.isupper() and first and y.islower())
        if y in CONT_SIGNS:
            return not _cyrillic(x) or after.isalpha() and y not in "«»"
        return x.isupper() and (before.islower() or after.islower() and not _cyrillic(x) and y not in "’'")
    if x in "¬Ÿ":
        return y in CONT_SIGNS or not y.isalnum() and not y.isspace()
    return before.isalpha() or after.isalpha()


def _cyrillic(c: str) -> bool:
    return "Ѐ" <= c <= "ԯ"


def _unread(text: str) -> tuple[str, int, str]:
    """Undo UTF-8 bytes read as something else: (text, replaced spans, reader)."""
    found = _matches(text)
    if not found:
        return text, 0, ""
    strong: Counter[str] = Counter()
    weak: Counter[str] = Counter()
    for k, (a, b, by) in enumerate(found):
        joined = k > 0 and found[k - 1][1] == a or k + 1 < len(found) and found[k + 1][0] == b
        runs = joined and (k > 0 and found[k - 1][1] == a and bool(set(found[k - 1][2]) & set(by)) or k + 1 < len(found) and found[k + 1][0] == b and bool(set(found[k + 1][2]) & set(by)))
        hit = _strong(text, a, b) or runs and (not text[a].isalpha() or _cyrillic(text[a]) or text[a].isupper())
        for enc in by:
            (strong if hit else weak)[enc] += b - a
    if not strong:
        return text, 0, ""
    reader = max(strong, key=lambda e: (strong[e] + weak[e], -READ_AS.index(e)))
    out, at, n = [], 0, 0
    for a, b, by in found:
        if reader in by:
            out += [text[at:a], by[reader]]
            at, n = b, n + 1
    return "".join([*out, text[at:]]), n, reader


SENTENCE = re.compile(r"[^\n.!?…]*[\n.!?…]*")
WHITE = frozenset(" \t\r\n.,;:!?()[]\"'/-*_<>")
NONASCII = re.compile(r"[^\x00-\x7f]")


RUN = re.compile(r"[^\x00-\x7f]+")
# Words of one letter.
SINGLE = frozenset("иИвВсСкКуУоОаАяЯіІйЙзЗηΗοΟ")


def _segments(text: str) -> tuple[str, int, str]:
    """Undo one single-byte encoding of Cyrillic or Greek read as another, run by run: (text, replaced spans, pair).

    Every run of foreign characters counts the letter pairs that are frequent after re-reading against those frequent as it
    stands. Neighbouring runs that speak for one pair of encodings are a garbled stretch if they hold enough of them; only
    its runs are replaced, so correct words beside it stay.
    """
    found = list(automaton().pairs.iter(text))
    if not found:
        return text, 0, ""
    runs = [(m.start(), m.end()) for m in RUN.finditer(text)]
    plain, upper = [0] * len(runs), [0] * len(runs)
    heard: list[list | None] = [None] * len(runs)
    k, last = 0, runs[0][1]
    for end, (kind, pairs) in found:
        while last <= end:
            k += 1
            last = runs[k][1]
        if kind == 1:
            plain[k] += 1
        elif kind:
            upper[k] += 1
        if pairs:
            if heard[k] is None:
                heard[k] = [pairs]
            else:
                heard[k].append(pairs)
    # A run that has more pairs as it stands speaks for no re-reading.
    hits = [Counter(chain.from_iterable(x)) if x and len(x) >= n else None for x, n in zip(heard, plain)]
    total: Counter[tuple[str, str]] = Counter()
    for h, n in zip(hits, plain):
        if h:
            total.update({p: c - n for p, c in h.items() if c > n})
    order = lambda p: ([*CYRILLIC, *GREEK_IN].index(p[0]), p[1])
    best = (0, None, [])
    for pair, n in sorted(total.items(), key=lambda kv: (-kv[1], order(kv[0])))[:8]:
        if n < 2:
            break
        chosen = _stretches(text, runs, hits, plain, upper, pair)
        score = sum((hits[k] or {}).get(pair, 0) - 2 * _wrong(_reread(text[slice(*runs[k])], *pair)) for k in chosen)
        if score > best[0]:
            best = (score, pair, chosen)
    _, pair, chosen = best
    if not pair:
        return text, 0, ""
    out, at = [], 0
    for k in chosen:
        a, b = runs[k]
        out += [text[at:a], _reread(text[a:b], *pair)]
        at = b
    return "".join([*out, text[at:]]), len(chosen), f"{pair[0]} read as {pair[1]}"


def _wrong(run: str) -> int:
    """Signs inside a word and capitals after small letters: what a wrong reading leaves."""
    return sum((x.islower() and y.isupper()) + (x.isalpha() and not y.isalpha() and y not in BESIDE) + (not x.isalpha() and x not in BESIDE and y.isalpha()) for x, y in zip(run, run[1:]))


def _stretches(text: str, runs: list[tuple[int, int]], hits: list, plain: list[int], upper: list[int], pair: tuple[str, str]) -> list[int]:
    """The runs to re-read with this pair of encodings."""
    # A run inside a word of ASCII letters is an accent, no word of its own.
    inside = [text[a - 1 : a].isascii() and text[a - 1 : a].isalpha() or text[b : b + 1].isascii() and text[b : b + 1].isalpha() for a, b in runs]
    gain = [-1 if inner else (h[pair] if h else 0) - n for h, n, inner in zip(hits, plain, inside)]
    strange = lambda i: _odd(text[slice(*runs[i])])
    out: list[int] = []
    k = 0
    while k < len(runs):
        if gain[k] <= 0:
            k += 1
            continue
        last = j = k
        while j < len(runs) and gain[j] >= 0 and (j == k or "\n" not in text[runs[j - 1][1] : runs[j][0]]):
            if gain[j] > 0:
                last = j
            j += 1
        own = range(k, last + 1)
        score, size = sum(gain[i] for i in own), sum(b - a for a, b in runs[k : last + 1])
        found = sum(h[pair] for i in own if (h := hits[i]))
        if found >= 0.22 * size and score > sum(upper[i] for i in own) and (score >= 4 or score >= 2 and size >= 4 and all(map(strange, own))):
            first = k
            # Words too short to speak for themselves follow their neighbours.
            while first and gain[first - 1] == 0 and first - 1 not in out and _follows(text, runs[first - 1], pair):
                first -= 1
            while last + 1 < len(runs) and gain[last + 1] == 0 and _follows(text, runs[last + 1], pair):
                last += 1
            out.extend(range(first, last + 1))
        k = max(j, last + 1)
    return sorted(set(out))


def _odd(run: str) -> bool:
    """Whether no correct text writes this run: four foreign Latin letters in a row, or a capital after a small letter."""
    if _cyrillic(run[0]) or "Ͱ" <= run[0] < "Ѐ":
        return len(run) > 2 and sum(x.islower() and y.isupper() for x, y in zip(run, run[1:])) > 0
    return len(run) >= 4


def _follows(text: str, span: tuple[int, int], pair: tuple[str, str]) -> bool:
    """Whether a run without frequent pairs belongs to the garbled stretch beside it."""
    run = text[span[0] : span[1]]
    again = _reread(run, *pair)
    if again == run or not all(_cyrillic(c) or "Ͱ" <= c < "Ѐ" or not c.isalpha() for c in again):
        return False
    latin = not any(_cyrillic(c) or "Ͱ" <= c < "Ѐ" for c in run)
    if len(run) == 1:
        return again in SINGLE and (latin or run not in SINGLE) or not again.isalpha() and latin
    return latin and again[1:].islower() or _odd(run) or again.islower() and run.isupper()


def _reread(seg: str, true: str, enc: str) -> str:
    """Characters that `enc` has are read again as `true`; ASCII and others stay."""
    out = []
    for c in seg:
        if not c.isascii():
            try:
                c = (c.encode("latin-1") if "\x80" <= c < "\xa0" else c.encode(enc)).decode(true)
            except UnicodeError:
                pass
        out.append(c)
    return "".join(out)


INSIDE = re.compile(r"(?<=[a-zß-öø-ÿœ])([^\x00-\x7fß-öø-ÿœ\s]{1,2})(?=[a-zß-öø-ÿœ])")


def _western(text: str) -> tuple[str, int, str]:
    """Undo western letters read with another single-byte encoding, inside lower-case words: (text, spans, pair)."""
    table = automaton().western
    votes: Counter[tuple[str, str]] = Counter()
    spots = []
    for m in INSIDE.finditer(text):
        if all(c in table for c in m[1]):
            spots.append(m)
            votes.update({(t, e) for c in m[1] for t, e, ch in table[c] if ch.islower()})
    if sum(1 if any(c > "Ͱ" for c in m[1]) else 0.5 for m in spots) < 1 or not votes:
        return text, 0, ""
    pair = max(votes.items(), key=lambda kv: (kv[1], kv[0]))[0]
    out, at, n = [], 0, 0
    for m in spots:
        to = [next((ch for t, e, ch in table[c] if (t, e) == pair and ch.islower()), None) for c in m[1]]
        if None not in to:
            out += [text[at : m.start()], *to]
            at, n = m.end(), n + 1
    return "".join([*out, text[at:]]), n, f"{pair[0]} read as {pair[1]}"


BESIDE_PLAIN = re.compile(r"(?<=[A-Za-z])[^\x00-\x7f]|[^\x00-\x7f](?=[A-Za-z])")


def _triple(text: str, at: int) -> str:
    """A letter between its neighbours; what no word holds is a space."""
    x = text[at - 1] if at else " "
    y = text[at + 1] if at + 1 < len(text) else " "
    return f"{' ' if x in WHITE else x}{text[at]}{' ' if y in WHITE else y}"


def _western_words(text: str) -> tuple[str, int, str]:
    """Undo western letters read with another single-byte encoding by the frequent triples of the text's language: (text, spans, pair).

    A sentence votes for a pair of encodings by its garbled triples, against those that the pair would spoil. A text of
    no western language, as its function words tell, needs two of them. A sign beside a word is no vote.
    """
    auto = automaton()
    # Every garbled triple holds a plain letter.
    if not any(_triple(text, m.start()) in auto.garbled_triples for m in BESIDE_PLAIN.finditer(text)):
        return text, 0, ""
    spots = [(m.start(), _triple(text, m.start())) for m in NONASCII.finditer(text)]
    sentences = [(m.start(), m.end()) for m in SENTENCE.finditer(text)]
    ends = [b for _, b in sentences]
    order = {p: -n for n, p in enumerate((t, e) for t in [*WESTERN, *CENTRAL] for e in dict.fromkeys([*WESTERN_READERS, *READ_AS]))}

    def vote(langs: set[str]) -> tuple[int, tuple[str, str] | None, dict]:
        """The pair of encodings with the most votes of these languages' triples, and its hits by sentence."""
        votes: Counter[tuple[str, str]] = Counter()
        hits: dict[tuple[int, tuple[str, str]], dict[int, str]] = {}
        spoiled: dict[int, list[str]] = {}
        for at, t in spots:
            k = bisect_right(ends, at)
            for true, enc, own, c in auto.garbled_triples.get(t, ()):
                if own in langs:
                    hits.setdefault((k, (true, enc)), {})[at] = c
            if not langs.isdisjoint(auto.triples.get(t, ())):
                spoiled.setdefault(k, []).append(t[1])
        for (k, pair), by in hits.items():
            sure = sum(text[at] not in BESIDE or text[at] not in WITHIN and text[at - 1 : at].isalpha() and text[at + 1 : at + 2].isalpha() or text[at] in "‚„" and text[at - 1 : at].isalpha() for at in by)
            against = sum(_reread(c, *pair) != c for c in spoiled.get(k, ()))
            if sure and len(by) > against:
                votes[pair] += sure
        pair = max(votes.items(), key=lambda kv: (kv[1], order[kv[0]]))[0] if votes else None
        return votes[pair], pair, hits

    # The text's own language tells by one triple; another one needs two, twice as many, and more than stand right.
    lang = prose.language(text)
    langs = {lang} if lang in WORDS else set(WORDS)
    n, pair, hits = vote(langs)
    if lang in WORDS:
        other = vote(set(WORDS))
        if other[0] > max(1, 2 * n, sum(t in auto.triples for _, t in spots)):
            langs = set(WORDS)
            n, pair, hits = other
    if pair is None or n < (1 if len(langs) == 1 else 2):
        return text, 0, ""
    letters = frozenset().union(*(auto.letters[x] for x in langs))
    to: dict[int, str] = {}
    for at, t in spots:
        own = hits.get((bisect_right(ends, at), pair))
        if not own:
            continue
        c = own.get(at) or _reread(text[at], *pair)
        inside = text[at - 1 : at].isalpha() and text[at + 1 : at + 2].isalpha()
        if at in own or c in letters and text[at] not in letters and (inside or text[at] not in BESIDE) or c in WRITTEN and text[at] not in BESIDE and text[at] not in letters:
            to[at] = c
    return "".join(to.get(k, c) for k, c in enumerate(text)), len(to), f"{pair[0]} read as {pair[1]}"


CONTROL = re.compile("[\x80-\x84\x86-\x9f]")


def _controls(text: str) -> tuple[str, int, str]:
    """C1 controls beside ASCII are quotes, dashes and the like of Windows text read as latin-1; others stay."""
    n = 0

    def back(m: re.Match) -> str:
        nonlocal n
        a, b = m.span()
        sides = [text[a - 1 : a], text[b : b + 1]]
        if all(x and not x.isascii() for x in sides) or any(not x.isascii() and not x.islower() for x in sides):
            return m[0]
        n += 1
        return _decode(m[0].encode("latin-1"), "cp1252")

    return CONTROL.sub(back, text), n, "cp1252 read as latin-1"


def repair(text: str) -> tuple[str, int, str, bool]:
    """(restored text, replaced spans, encodings, damaged): damaged says that some of the text can't be brought back.

    Text without garbled sequences is returned as it is, with 0 spans.
    """
    if text.isascii():
        return text, 0, "", False
    total, names = 0, []

    def note(n: int, name: str) -> None:
        nonlocal total
        total += n
        if name not in names:
            names.append(name)

    for _ in range(8):  # stretches of other pairs of encodings
        text, n, name = _segments(text)
        if not n:
            break
        note(n, name)
    while True:  # text can be garbled several times over; every pass makes it shorter
        text, n, reader = _unread(text)
        if not n:
            break
        note(n, f"utf-8 read as {reader}")
    text, n, name = _western_words(text)
    if n:
        note(n, name)
    else:
        text, n, name = _western(text)
        if n:
            note(n, name)
    text, n, name = _controls(text)
    if n:
        note(n, name)
    return text, total, ", ".join(names), "�" in text or CONTROL.search(text) is not None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i, text in zip(*(c.to_pylist() for c in batch.columns)):
            fixed, n, names, lost = repair(text)
            if n or lost:
                out.append((i, n, names, lost, fixed))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(5)], ["doc_id", "spans", "encodings", "damaged", "restored"])


def garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, encodings, damaged, restored): the documents that were decoded wrongly, wholly or in part.

    damaged: the text holds replacement characters or control characters of an unknown reading, so some of it can't be restored. Null, empty and ASCII-only texts
    are no cases. Rows that come twice come out twice. A narrow map: no shuffle.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]"))
    return src.mapInArrow(_rows, "doc_id long, spans long, encodings string, damaged boolean, restored string")

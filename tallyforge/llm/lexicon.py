"""Word lists for scoring abusive, hateful and sexual language, and the undoing of disguises.

The lists are fixed values, in English, German, French and Spanish. They only make features: which of
them matter, and how much, is learned from labels.
"""

from __future__ import annotations

import re

#: Words by category, as general lists of such language have them.
WORDS = {
    "insult": """
        idiot idiots idiotic moron morons moronic imbecile imbeciles stupid dumb dumbass fool fools foolish retard retards
        retarded cretin cretins halfwit dimwit nitwit dunce simpleton loser losers clown clowns buffoon pathetic worthless
        useless brainless gutless spineless clueless weasel snake pig pigs swine cow hag rat rats bastard bastards bitch
        bitches asshole assholes arsehole prick pricks dick dicks dickhead dickheads dipshit jackass wanker wankers twat
        twats cunt cunts scumbag scumbags scum creep creeps freak freaks whore whores slut sluts skank tramp ugly fat
        fatso disgusting repulsive revolting greasy filthy vile nasty miserable liar liars lying cheat coward cowards
        cowardly lazy incompetent ignorant trash garbage crybaby psycho lunatic
        idiotisch vollidiot idioten trottel dumm dummkopf blöd arsch arschloch wichser schlampe hure hurensohn missgeburt
        schwachkopf depp spinner versager drecksau
        imbécile imbéciles idiote idiots connard connards connasse con conne salope salaud abruti débile crétin pute putes
        enculé ordure bouffon minable
        imbécil imbéciles idiota idiotas estúpido estúpida inútil puta puto cabrón cabrones gilipollas pendejo tonto tonta
        zorra maldito asqueroso""",
    "profanity": """
        fuck fucks fucked fucking fucker fuckers motherfucker shit shits shitty bullshit piss pissed crap crappy hell damn
        damned goddamn bloody bollocks bugger wtf stfu
        scheiße scheisse scheiß verdammt verpiss fick ficken kacke fresse
        merde putain bordel foutre gueule chier joder coño carajo hostia mierda cojones""",
    "sexual": """
        porn porno pornography pornographic nude nudes naked topless undress undressed lick licking tits boobs breasts
        nipples blowjob handjob masturbate masturbating masturbation horny sex sexual sexy orgasm orgasms cum cock cocks
        pussy anal anus ass arse penis dick vagina erotic erection panties bra lingerie stripper thong kinky fetish bdsm
        dildo escort hooker prostitute incest xxx
        nacktbilder nackt nackte titten geil schwanz muschi blasen
        nue nues nu nus seins bite chatte baiser sucer
        desnuda desnudo desnudas tetas polla coño coger follar chupar""",
    "violence": """
        kill killed killing kills murder murdered die dies died dead death bleed blood bloody hurt harm smash break beat
        beaten beating choke strangle stab stabbed shoot shot gun knife burn bomb explode punch kick slap hit crush
        rape raped torture attack hang hanged drown erase eradicate exterminate gas lynch behead execute execution destroy
        suffer threat threaten revenge
        töten umbringen schlagen verrecken erschießen sterben crever frapper tuer mourir matar muerte golpear morir""",
    "dehumanise": """
        vermin disease diseases infected infection infest parasite parasites subhuman subhumans animal animals apes monkeys
        cage filth plague cockroach cockroaches rodents insects inferior savage savages barbarians leeches cancer scum
        invaders deport steal
        ungeziefer parasiten untermenschen abschaum pack vermine parasites plaga ratas escoria parásitos animales""",
    "group": """
        migrants migrant immigrants immigrant foreigners foreigner refugees refugee minorities women woman girls men gays
        gay lesbian lesbians queers queer trans transgender disabled cripples elderly muslims muslim jews jewish jew
        christians christian catholics hindus buddhists atheists blacks black whites white asians arabs africans mexicans
        latinos indians chinese gypsies gypsy natives people race races religion religious tribe ethnic
        ausländer flüchtlinge juden moslems frauen behinderte schwule zigeuner migranten
        étrangers étranger immigrés migrants réfugiés femmes juifs musulmans noirs arabes
        inmigrantes inmigrante extranjeros refugiados mujeres judíos musulmanes gitanos negros""",
    "second": """
        you your yours yourself you're you'd you'll you've u ur du dich dir dein deine ihr euch tu toi te ta ton tes vous
        votre vos t'es tú ti tus eres usted ustedes vuestra""",
    "first": "i i'll i'd i'm me my we us our ich mir mich wir je j'ai moi nous yo mí nosotros",
    "benign": """
        policy policies conduct code forbids forbidden prohibited prohibits complaint complaints harassment hotline
        training course glossary definition term terms filter filtered report reported reports quoted quote alleged
        investigation study research article history education medical clinic hospital""",
}

_CODES = {name: 1 << i for i, name in enumerate(WORDS)}
CATEGORIES = tuple(WORDS)
STRONG = ("insult", "profanity", "sexual", "violence", "dehumanise")

_BY_WORD: dict[str, int] = {}
for _name, _words in WORDS.items():
    for _w in _words.split():
        _BY_WORD[_w] = _BY_WORD.get(_w, 0) | _CODES[_name]

#: Words that are worth finding behind a disguise: not pronouns, groups or harmless context.
_HIDDEN = {w: c for w, c in _BY_WORD.items() if c & (_CODES["insult"] | _CODES["profanity"] | _CODES["sexual"] | _CODES["dehumanise"]) and len(w) >= 3}
_RUN = re.compile(r"(.)\1+")
_SQUEEZED: dict[str, str] = {}
for _w in _HIDDEN:
    if len(_RUN.sub(r"\1", _w)) >= 3:
        _SQUEEZED.setdefault(_RUN.sub(r"\1", _w), _w)
_BY_LENGTH: dict[int, list[str]] = {}
for _w in _HIDDEN:
    _BY_LENGTH.setdefault(len(_w), []).append(_w)
#: Characters written for letters.
_LEET = str.maketrans({"@": "a", "4": "a", "$": "s", "5": "s", "0": "o", "1": "i", "!": "i", "|": "i", "3": "e", "€": "e", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g"})
_EDGE = re.compile(r"^[^\w@$*#]+|[^\w@$*#]+$")
_MASK = re.compile(r"[*#_%&?~.\-•·×]")


def category(word: str) -> int:
    return _BY_WORD.get(word, 0)


def bits(name: str) -> int:
    return _CODES[name]


def _masked(word: str) -> str | None:
    """A listed word of that length, equal wherever the word has letters and masked where it has signs."""
    pattern = _MASK.sub("?", word)
    letters = [(i, c) for i, c in enumerate(pattern) if c != "?"]
    if not letters or "?" not in pattern or len(letters) + 1 < 2:
        return None
    for w in _BY_LENGTH.get(len(word), ()):
        if all(w[i] == c for i, c in letters) and (len(letters) >= 2 or len(w) <= 3):
            return w
    return None


def plain(token: str) -> tuple[str, bool]:
    """The word a token stands for, in lower case without signs around it, and whether it was disguised."""
    word = _EDGE.sub("", token.lower().replace("’", "'"))
    if word in _BY_WORD or (word.isalpha() and not _RUN.search(word)):
        return word, False
    if not any(map(str.isalpha, word)) and not any(c in "@$" for c in word):
        return word, False
    if word.isalpha():
        found = _SQUEEZED.get(_RUN.sub(r"\1", word))
        return (found, True) if found and found != word else (word, False)
    parts = re.split(r"[.\-_*·\s]", word)
    if len(parts) >= 3 and all(len(p) == 1 for p in parts if p) and sum(map(len, parts)) >= 3:
        joined = "".join(parts)
        if joined in _HIDDEN:
            return joined, True
    swapped = word.translate(_LEET)
    if swapped != word:
        for one in (swapped, swapped.replace("i", "l") if "1" in word or "|" in word or "!" in word else swapped):
            if one in _HIDDEN:
                return one, True
            found = _SQUEEZED.get(_RUN.sub(r"\1", one)) if one.isalpha() and one != word else None
            if found and len(found) >= 4:
                return found, True
    if _MASK.search(word):
        found = _masked(word) or (_masked(swapped) if swapped != word else None)
        if found:
            return found, True
    return word, False


def spelled(letters: str) -> str | None:
    """The listed word that single letters in a row spell, alone or within the row."""
    word = letters.lower().translate(_LEET)
    if word in _HIDDEN:
        return word
    found = _SQUEEZED.get(_RUN.sub(r"\1", word))
    return found if found and len(word) >= 3 else None

"""Published suffix stemmers as tables of rules, which become column expressions (no Python at run time).

A stemmer is a list of steps. In a step the longest ending that the word has, among those with the step's `limit`, is
the one that counts: where what stands before it meets the rule's `need`, the ending is replaced, else the word stays.
Regions of a word (after the first vowel and consonant, and so on) are conditions on what stands before an ending:
the ending lies in the region exactly if the rest reaches it. The same tables give SQL text, for comparison.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private letters: a word that is to stay as it is, and an ending that the next step looks at.
STAY, MARK = "\ue000", "\ue001"


@dataclass(frozen=True)
class Rule:
    """An ending, what replaces it, and patterns that the rest must match and must not match."""

    end: str
    by: str = ""
    need: tuple[str, ...] = ()
    unless: str = ""


@dataclass(frozen=True)
class Endings:
    """One step: the longest ending counts, among those whose rest matches limit."""

    rules: tuple[Rule, ...]
    limit: tuple[str, ...] = ()

    def ordered(self) -> list[Rule]:
        return sorted(self.rules, key=lambda r: -len(r.end))


@dataclass(frozen=True)
class Replace:
    """One step: every match of a pattern is replaced, in words of at least so many letters; $1 is its first group."""

    pattern: str
    by: str
    least: int = 0


Stemmer = tuple[Endings | Replace, ...]


def ends(words: str, by: str = "", *need: str, unless: str = "") -> tuple[Rule, ...]:
    return tuple(Rule(w, by, need, unless) for w in words.split())


def pairs(table: str, *need: str) -> tuple[Rule, ...]:
    """Rules written as ending>replacement."""
    return tuple(Rule(a, b, need) for a, b in (x.split(">") for x in table.split()))


def _fits(x: Column, patterns) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & x.rlike(p)
    return out


def step_column(step: Endings | Replace, t: Column) -> Column:
    if isinstance(step, Replace):
        new = F.regexp_replace(t, step.pattern, step.by)
        return F.when(F.char_length(t) >= step.least, new).otherwise(t) if step.least else new
    out, rules = None, step.ordered()
    if all(r.end for r in rules):  # by last letter, so that most words are compared with few endings
        for last in dict.fromkeys(r.end[-1] for r in rules):
            own = _cases([r for r in rules if r.end[-1] == last], step.limit, t)
            out = F.when(t.endswith(last), own) if out is None else out.when(t.endswith(last), own)
        return t if out is None else out.otherwise(t)
    return _cases(rules, step.limit, t)


def _cases(rules: list[Rule], limit: tuple[str, ...], t: Column) -> Column:
    """The first of the rules whose ending fits."""
    out = None
    for r in rules:
        rest = F.left(t, F.char_length(t) - len(r.end))
        hit = t.endswith(r.end) & _fits(rest, limit) if limit else t.endswith(r.end)
        ok = _fits(rest, r.need) & ~rest.rlike(r.unless) if r.unless else _fits(rest, r.need)
        new = F.when(ok, F.concat(rest, F.lit(r.by))).otherwise(t) if r.need or r.unless else F.concat(rest, F.lit(r.by)) if r.by else rest
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return out.otherwise(t)


def _stepped(step: Endings | Replace, token: Column) -> Column:
    return F.struct(step_column(step, token["term"]).alias("term"), token["pos"].alias("pos"))


def stem(stemmer: Stemmer):
    """A token filter; each step maps the array of tokens once, so that no step's result is computed twice."""

    def run(toks: Column) -> Column:
        for step in stemmer:
            toks = F.transform(toks, partial(_stepped, step))
        return toks

    def plain(words: Column) -> Column:
        for step in stemmer:
            words = F.transform(words, partial(step_column, step))
        return words

    run.plain = plain
    return run


def step_sql(step: Endings | Replace, x: str) -> str:
    if isinstance(step, Replace):
        new = f"regexp_replace({x}, '{step.pattern}', '{step.by.replace('$', chr(92))}', 'g')"
        return f"CASE WHEN length({x}) >= {step.least} THEN {new} ELSE {x} END" if step.least else new
    cases = []
    for r in step.ordered():
        rest = f"left({x}, length({x}) - {len(r.end)})"
        fits = lambda ps, rest=rest: "".join(f" AND regexp_matches({rest}, '{p}')" for p in ps)
        no = f" AND NOT regexp_matches({rest}, '{r.unless}')" if r.unless else ""
        cases.append(f"WHEN ends_with({x}, '{r.end}'){fits(step.limit)} THEN CASE WHEN true{fits(r.need)}{no} THEN {rest} || '{r.by}' ELSE {x} END")
    return f"CASE {' '.join(cases)} ELSE {x} END"


def stem_sql(stemmer: Stemmer, words: str) -> str:
    """DuckDB SQL that maps a list of words."""
    for step in stemmer:
        words = f"list_transform({words}, lambda x: {step_sql(step, 'x')})"
    return words


# ---- English: measures count vowel runs followed by consonants; a consonant y is written Y meanwhile
_V, _C = "[aeiouy]", "[^aeiouy]"
_M0, _M1 = _V + _C, f"{_V}{_C}+{_V}+{_C}"
_CVC = f"^{_C}+{_V}[^aeiouywxY]$"
# The endings of the English suffix-stripping algorithm, with its two published departures.
PORTER: Stemmer = (
    Replace("^(.{1,2})$", "$1" + STAY),
    Replace("(^|[aeiouy])y", "$1Y"),
    Endings(pairs("sses>ss ies>i ss>ss s>")),
    Endings((*pairs("eed>ee", _M0), *ends("ed ing", MARK, _V))),
    Endings((*pairs(f"at{MARK}>ate bl{MARK}>ble iz{MARK}>ize"), *(Rule(c + c + MARK, c) for c in "bcdfghjkmnpqrtvwxY"), Rule(MARK, "e" + MARK, (_CVC,)))),
    Replace(MARK, ""),
    Endings(ends("y Y", "i", _V)),
    Endings(pairs("ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log", _M0)),
    Endings(pairs("icate>ic ative> alize>al iciti>ic ical>ic ful> ness>", _M0)),
    Endings((*ends("al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize", "", _M1), Rule("ion", "", (_M1, "[st]$")))),
    Endings((Rule("e", "", (_M0,), _CVC),)),
    Endings((Rule("l", "", (_M1, "l$")),)),
    Replace("Y", "y"),
    Replace(STAY, ""),
)

# ---- Nordic: endings after the first vowel and consonant, three letters in at least
_NV = "[aeiouyæåøäö]"
_R1 = f".{_NV}[^aeiouyæåøäö]|{_NV}[^aeiouyæåøäö]."
# The endings of the published Danish, Norwegian and Swedish algorithms.
_PAIRS_DA = Endings(pairs("gd>g dt>d gt>g kt>k"), (_R1,))
DANISH: Stemmer = (
    Endings((*ends("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret"), Rule("s", "", ("[abcdfghjklmnoprtvyzå]$",))), (_R1,)),
    _PAIRS_DA,
    Replace("igst$", "ig"),
    Endings((*ends("ig lig elig els", MARK), Rule("løst", "løs")), (_R1,)),
    Endings(tuple(Rule(a + MARK, b) for a, b in (("gd", "g"), ("dt", "d"), ("gt", "g"), ("kt", "k"))), (_R1,)),
    Replace(MARK, ""),
    Endings(tuple(Rule(c, "", (c + "$",)) for c in "bcdfghjklmnpqrstvwxz"), (_R1,)),
)
NORWEGIAN: Stemmer = (
    Endings((*ends("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast"), *ends("erte ert", "er"), Rule("s", "", ("[bcdfghjlmnoprtvyz]$|[^aeiouyæåø]k$",))), (_R1,)),
    Endings(pairs("dt>d vt>v"), (_R1,)),
    Endings(ends("leg eleg ig eig lig elig els lov elov slov hetslov"), (_R1,)),
)
SWEDISH: Stemmer = (
    Endings((*ends("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast"), Rule("s", "", ("[bcdfghjklmnoprtvy]$",))), (_R1,)),
    Endings(pairs("dd>d gd>g nn>n dt>d gt>g kt>k tt>t"), (_R1,)),
    Endings((*ends("lig ig els"), *pairs("löst>lös fullt>full")), (_R1,)),
)

# ---- German: u and y between vowels are consonants, written in upper case meanwhile
_GV = "[aeiouyäöü]"
_GR1, _GR2 = f".{_GV}[^aeiouyäöü]|{_GV}[^aeiouyäöü].", f"{_GV}[^aeiouyäöü].*{_GV}[^aeiouyäöü]"
# The endings of the published German algorithm.
GERMAN: Stemmer = (
    Replace("ß", "ss"),
    Replace(f"({_GV})u([aeiouyäöü])", "$1U$2"),
    Replace(f"({_GV})y([aeiouyäöü])", "$1Y$2"),
    Endings((*ends("em ern er", "", _GR1), *ends("e en es", MARK, _GR1), Rule("s", "", (_GR1, "[bdfghklmnrt]$")))),
    Endings((Rule("niss" + MARK, "nis"), Rule(MARK))),
    Endings((*ends("en er est", "", _GR1), Rule("st", "", (_GR1, "...[bdfghklmnt]$")))),
    Endings((*ends("end ung", MARK, _GR2), *ends("ig ik isch", "", _GR2, unless="e$"), *ends("lich heit", MARK + "l", _GR2), Rule("keit", MARK + "k", (_GR2,)))),
    Endings((Rule("ig" + MARK, "", (_GR2,), "e$"), *ends(f"er{MARK}l en{MARK}l", "", _GR1), *ends(f"lich{MARK}k ig{MARK}k", "", _GR2))),
    Replace(f"{MARK}[lk]?", ""),
    Replace("U", "u"),
    Replace("Y", "y"),
    Replace("ä", "a"),
    Replace("ö", "o"),
    Replace("ü", "u"),
)

# ---- Russian: endings after the first vowel; a group of endings needs а or я after it
_RV = "[аеиоуыэюя]"
_AYA = f"{_RV}.*[ая]$"
_RR2 = f"{_RV}[^аеиоуыэюя].*{_RV}[^аеиоуыэюя]"


def _after(words: str, by: str = "") -> tuple[Rule, ...]:
    return ends(words, by, _AYA)


# The endings of the published Russian algorithm. MARK ends a word whose form is settled.
RUSSIAN: Stemmer = (
    Replace("ё", "е"),
    Endings((*_after("в вши вшись", MARK), *ends("ив ивши ившись ыв ывши ывшись", MARK)), (_RV,)),
    Endings(ends("ся сь"), (_RV,)),
    Endings(ends("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею", MARK + "p"), (_RV,)),
    Endings(
        (*(Rule(e + MARK + "p", MARK, (_AYA,)) for e in "ем нн вш ющ щ".split()), *(Rule(e + MARK + "p", MARK) for e in "ивш ывш ующ".split())),
        (_RV,),
    ),
    Endings((*_after("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", MARK), *ends("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю", MARK)), (_RV,)),
    Endings(ends("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"), (_RV,)),
    Replace(f"{MARK}p?", ""),
    Endings(ends("и"), (_RV,)),
    Endings(ends("ост ость", "", _RR2), (_RV,)),
    Endings((*ends("ейш ейше", MARK), Rule("нн", "н"), Rule("ь")), (_RV,)),
    Endings((Rule("нн" + MARK, "н"), Rule(MARK)), ()),
)

STEMMERS: dict[str, Stemmer] = {"porter": PORTER, "danish": DANISH, "norwegian": NORWEGIAN, "swedish": SWEDISH, "german": GERMAN, "russian": RUSSIAN}

# ---- Hindi: the longest ending that leaves two letters. The endings of the published light stemmer.
HINDI: Stemmer = (
    Endings(
        ends(
            "ाएंगी ाएंगे ाऊंगी ाऊंगा ाइयाँ ाइयों ाइयां "
            "ाएगी ाएगा ाओगी ाओगे एंगी ेंगी एंगे ेंगे ूंगी ूंगा ातीं नाओं नाएं ताओं ताएं ियाँ ियों ियां "
            "ाकर ाइए ाईं ाया ेगी ेगा ोगी ोगे ाने ाना ाते ाती ाता तीं ाओं ाएं ुओं ुएं ुआं "
            "कर ाओ िए ाई ाए ने नी ना ते ीं ती ता ाँ ां ों ें ो े ू ु ी ि ा"
        ),
        ("..",),
    ),
)

# ---- Arabic: one prefix, then each ending once, in turn. Those of the published light stemmer.
ARABIC: Stemmer = (
    Replace("^(?:ال|وال|بال|كال|فال|لل)(..+)$|^و(...+)$", "$1$2"),
    *(Replace(f"^(..+){end}$", "$1") for end in "ها ان ات ون ين يه ية ه ة ي".split()),
)

# ---- light stemmers, which leave three letters or take words of five. The published endings.
_MARKED = (("àáâä", "a"), ("òóôö", "o"), ("ìíîï", "i"), ("ùúûü", "u"))
GERMAN_LIGHT: Stemmer = (
    *(Replace(f"[{letters}]", plain) for letters, plain in _MARKED),
    Endings((*ends("ern em en er es e"), Rule("s", "", ("[bdfghklmnt]$",))), ("...",)),
    Endings((*ends("est er en"), Rule("st", "", ("[bdfghklmnt]$",))), ("...",)),
)
SPANISH_LIGHT: Stemmer = (
    *(Replace(f"[{letters}]", plain, 5) for letters, plain in (*_MARKED, ("èéêë", "e"))),
    Replace("^(.{1,4})$", "$1" + STAY),
    Endings(pairs("eses>es ces>z os> as> es> o> a> e>")),
    Replace(STAY, ""),
)
SWEDISH_LIGHT: Stemmer = (
    Endings(ends("s"), ("....",)),
    Endings(ends("elser heten arne erna ande else aste orna aren are ast het ar er or en at te et t a e n"), ("...",)),
)
STEMMERS |= {"hindi": HINDI, "arabic": ARABIC, "german_light": GERMAN_LIGHT, "spanish_light": SPANISH_LIGHT, "swedish_light": SWEDISH_LIGHT}

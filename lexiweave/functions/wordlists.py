"""Words of the taggers: closed classes in full, open classes as base forms that rules inflect."""

from __future__ import annotations

import re

ENGLISH_CLOSED = {
    "DET": """a all an another any both each either every few fewer half her his its many more most much my neither no our several some such that the their
        these this those your""",
    "CCONJ": "and but nor or plus yet",
    "ADP": """aboard about above across after against along amid among around as at before behind below beneath beside between beyond by despite down during except
        for from in inside into near of off on onto opposite outside over past per since through throughout to toward towards under until up upon
        via with within without""",
    "ADV": """again almost already also always away ever far fast hard hardly here how indeed just maybe never now often once only perhaps quite rarely rather
        really seldom so sometimes soon still then there today together tomorrow too twice very well when where why yesterday""",
    "PRON": """anybody anyone anything everybody everyone everything he hers herself him himself i it itself me mine myself nobody nothing one ours ourselves she somebody
        someone something theirs them themselves they us we what which who whom whose you yours yourself""",
    "AUX": "am are be been being can could did do does had has have having is may might must ought shall should was were will would",
    "PART": "'s n't not",
    "SCONJ": "although because if lest provided though unless whereas whether while",
    "INTJ": "ah alas hello hey oh please thanks wow yes",
    "NUM": """billion eight eighteen eighty eleven fifteen fifty five forty four fourteen hundred million nine nineteen ninety seven seventeen seventy six sixteen sixty
        ten thirteen thirty thousand three twelve twenty two zero""",
}
ENGLISH_ADJECTIVES = """able ancient angry bad beautiful better big bitter black blue brave brief bright broad broken brown busy calm careful cheap clean clear clever
    cold common cool curious dark dead dear deep different difficult dirty dry dull dusty early easy empty equal fair false famous fat final fine first flat
    foreign free fresh friendly full gentle glad gold good grand gray great green grey happy healthy heavy high hollow honest hot huge human hungry important
    kind large last late lazy light little local lonely long loose loud low lucky main modern narrow natural new nice noble noisy old open orange other own
    pale plain pleasant poor possible pretty private proud public pure purple quick quiet rare raw ready real red rich right ripe rough round royal sad safe
    same second serious shallow sharp shiny short shy sick silent silver similar simple single slow small smart smooth soft solid sour special steep strange strict
    strong sudden sweet tall tame thick thin third tidy tiny tired true ugly useful usual vast warm weak wet white whole wide wild wise wooden wrong yellow
    young""".split()
ENGLISH_VERBS = """accept add agree allow answer appear arrive ask attack bake bark become begin believe belong boil borrow break bring build burn buy call carry catch
    change chase chew choose clap climb close collect come contain continue cook copy count cover cross cry cut dance decide describe die discover draw dream dress
    drink drive drop eat enjoy enter explain fall fear feed feel fight fill find finish fix float fly fold follow forget forgive freeze get give go grow guard guess
    guide happen hate hear help hide hit hold hope hunt include invite join jump keep kick kill kiss know laugh lead learn leave lend let lie lift like listen live look lose love
    make mark measure meet melt mend move need notice obey occur offer open own pass pay pick plan play pour praise press promise pull push put reach read receive
    remain remember repair repeat reply rest return ride ring rise roll run save say see seem sell send serve shake shine shout show shut sing sit sleep smell smile speak spend
    stand start stay steal stop study swim take talk taste teach tell thank think throw touch travel try turn understand use visit wait wake walk want wash watch wear
    weave win wish wonder work worry write""".split()
#: Past and participle where no rule gives them.
ENGLISH_IRREGULAR = {
    "become": "became become", "begin": "began begun", "break": "broke broken", "bring": "brought brought", "build": "built built", "buy": "bought bought",
    "catch": "caught caught", "choose": "chose chosen", "come": "came come", "cut": "cut cut", "draw": "drew drawn", "drink": "drank drunk",
    "drive": "drove driven", "eat": "ate eaten", "fall": "fell fallen", "feed": "fed fed", "feel": "felt felt", "fight": "fought fought", "find": "found found",
    "fly": "flew flown", "forget": "forgot forgotten", "forgive": "forgave forgiven", "freeze": "froze frozen", "get": "got gotten", "give": "gave given",
    "go": "went gone", "grow": "grew grown", "hear": "heard heard", "hide": "hid hidden", "hit": "hit hit", "hold": "held held", "keep": "kept kept",
    "know": "knew known", "lead": "led led", "leave": "left left", "lend": "lent lent", "let": "let let", "lie": "lay lain", "lose": "lost lost",
    "make": "made made", "meet": "met met", "pay": "paid paid", "put": "put put", "read": "read read", "ride": "rode ridden", "ring": "rang rung",
    "rise": "rose risen", "run": "ran run", "say": "said said", "see": "saw seen", "sell": "sold sold", "send": "sent sent", "shake": "shook shaken",
    "shine": "shone shone", "show": "showed shown", "shut": "shut shut", "sing": "sang sung", "sit": "sat sat", "sleep": "slept slept", "speak": "spoke spoken",
    "spend": "spent spent", "stand": "stood stood", "steal": "stole stolen", "swim": "swam swum", "take": "took taken", "teach": "taught taught", "tell": "told told",
    "think": "thought thought", "throw": "threw thrown", "understand": "understood understood", "wake": "woke woken", "wear": "wore worn", "weave": "wove woven",
    "win": "won won", "write": "wrote written",
}
#: Nouns whose endings look like a verb's or an adverb's.
ENGLISH_NOUNS = """anything bed beginning being breed building butterfly ceiling clothing daily deed drawing evening family feeling fly hundred island jelly king lily
    meaning meeting morning opening painting seed shed shilling sled speed spring string supply thing wedding weed wing""".split()
#: Words that are verbs and nouns alike, besides those that endings or lists decide.
ENGLISH_BOTH = """answer bear book call change cook cut dance dream dress drink drop duck fall fear fight fish fly guess guide help hope hunt jump kick kiss laugh light link look love
    mark measure move need offer park plan plant play press promise pull push rest ride ring rise rock roll run saw shout show sleep smell smile start stop study swim talk taste
    time touch train travel try turn use visit wait walk wash watch water wish wonder work worry""".split()
#: Other words with several tags.
ENGLISH_SEVERAL = {
    "after": "ADP SCONJ", "as": "ADP SCONJ", "before": "ADP SCONJ", "can": "AUX NOUN", "clean": "ADJ VERB", "close": "VERB ADJ", "down": "ADP ADV", "dry": "ADJ VERB",
    "fast": "ADV ADJ", "for": "ADP CCONJ", "hard": "ADV ADJ", "her": "DET PRON", "left": "VERB ADJ NOUN", "like": "VERB ADP", "may": "AUX NOUN", "no": "DET INTJ", "open": "ADJ VERB",
    "out": "ADP ADV", "own": "ADJ VERB", "right": "ADJ NOUN ADV", "since": "ADP SCONJ", "so": "ADV CCONJ", "that": "PRON DET SCONJ", "to": "PART ADP", "until": "ADP SCONJ",
    "up": "ADP ADV", "well": "ADV NOUN ADJ", "will": "AUX NOUN", "yet": "CCONJ ADV",
}
ENGLISH_MODALS = "can could may might must ought shall should will would".split()
ENGLISH_NEGATIVE = "hardly n't never no not rarely seldom".split()
ENGLISH_RELATIVE = "how that what when where which who whom whose why".split()

SPANISH_CLOSED = {
    "DET": "algunas algunos aquel aquella aquellas aquellos cada el esa esas ese esos esta estas este estos la las los mi mis muchas muchos nuestra nuestro otra otro su sus todas todos tu tus un una unas unos",
    "CCONJ": "e mas ni o pero sino u y",
    "ADP": "a al ante bajo con contra de del desde durante en entre excepto hacia hasta mediante para por según sin sobre tras",
    "ADV": "ahora ahí allí antes apenas aquí así ayer bien casi cerca después donde hoy jamás lejos luego mal mañana más menos mucho muy nunca pronto quizás siempre sí también tampoco tarde temprano todavía ya",
    "PRON": "él ella ellas ello ellos le les lo me mí nada nadie nos nosotras nosotros os que quien quienes se te ti usted ustedes vosotras vosotros yo",
    "AUX": "es era eran eres está están estaba estaban estar fue fueron fui ha habían había haber han he hemos puede pueden ser será serán sido son soy",
    "PART": "no",
    "SCONJ": "aunque como cuando mientras porque pues si",
    "NUM": "ciento cien cinco cuatro diez doce dos mil nueve ocho once quince seis siete tres trece veinte",
}
#: Adjectives in -o have four forms, those in -e or a consonant two.
SPANISH_ADJECTIVES = """alto ancho antiguo azul bajo barato blanco bonito breve bueno caro claro común corto débil difícil distinto dulce duro fácil falso famoso feliz feo frío fuerte grande
    gris hermoso joven largo lento libre limpio lleno malo negro notable nuevo pequeño plural pobre precioso profundo rápido raro rico rojo seco simple suave sucio tonto triste verde viejo vivo""".split()
SPANISH_VERBS = """abrir amar andar aprender ayudar bailar beber buscar caminar cantar comer comprar contar correr cortar creer cruzar dejar escribir escuchar esperar estudiar ganar
    guiar hablar leer llamar llegar llevar llorar mirar nadar pagar pasar pensar perder pintar preguntar rodear romper saltar señalar subir tomar trabajar usar vender viajar vivir""".split()


def english_forms(base: str) -> dict[str, str]:
    """Third person, participle in -ing, past and past participle of a verb."""
    doubled = base + base[-1] if re.fullmatch(r"[^aeiou]*[aeiou][bdgklmnprt]", base) else base
    soft = base[-1] == "y" and base[-2] not in "aeiou"
    third = base[:-1] + "ies" if soft else base + ("es" if re.search(r"(s|x|z|ch|sh|o)$", base) else "s")
    if base.endswith("ie"):
        ing = base[:-2] + "ying"
    else:
        ing = (base[:-1] if base[-1] == "e" and base[-2:] not in ("ee", "oe", "ye") else doubled) + "ing"
    regular = base[:-1] + "ied" if soft else base + "d" if base[-1] == "e" else doubled + "ed"
    past, participle = ENGLISH_IRREGULAR.get(base, f"{regular} {regular}").split()
    return {"third": third, "ing": ing, "past": past, "participle": participle}


def spanish_forms(base: str) -> list[str]:
    """The commonest regular forms of a verb; changes of the stem are left out."""
    stem, kind = base[:-2], base[-2:]
    a = kind == "ar"
    present = ["o", "as", "a", "amos", "an"] if a else ["o", "es", "e", "emos" if kind == "er" else "imos", "en"]
    past = ["é", "ó", "aron", "aba", "aban", "ando", "ado"] if a else ["í", "ió", "ieron", "ía", "ían", "iendo", "ido"]
    return [base, *(stem + e for e in present + past)]


def english_tags() -> dict[str, list[str]]:
    """Tag → words; a word stands under the first tag that has it."""
    lists = {k: v.split() for k, v in ENGLISH_CLOSED.items()}
    lists["NOUN"] = list(ENGLISH_NOUNS)
    lists["ADJ"] = list(ENGLISH_ADJECTIVES)
    lists["VERB"] = [f for b in ENGLISH_VERBS for f in (b, *english_forms(b).values())]
    return _first(lists)


def spanish_tags() -> dict[str, list[str]]:
    lists = {k: v.split() for k, v in SPANISH_CLOSED.items()}
    lists["ADJ"] = [f for a in SPANISH_ADJECTIVES for f in ([a, a[:-1] + "a", a + "s", a[:-1] + "as"] if a.endswith("o") else [a, a + ("s" if a[-1] in "aeiou" else "es")])]
    lists["VERB"] = [f for v in SPANISH_VERBS for f in spanish_forms(v)]
    return _first(lists)


def _first(lists: dict[str, list[str]]) -> dict[str, list[str]]:
    seen: set[str] = set()
    out = {}
    for tag, ws in lists.items():
        out[tag] = [w for w in dict.fromkeys(ws) if w not in seen]
        seen |= set(out[tag])
    return out


def ambiguous() -> dict[str, str]:
    """Word → its candidate tags; the tag of the lists comes first."""
    own = {w: t for t, ws in english_tags().items() for w in ws}
    out = dict(ENGLISH_SEVERAL)
    for base in ENGLISH_BOTH:
        for form in (base, english_forms(base)["third"]):
            first = own.get(form, "NOUN")
            out.setdefault(form, " ".join(dict.fromkeys([first, "VERB", "NOUN"])))
    return out


def participles() -> frozenset[str]:
    """Past participles that do not end in -ed."""
    return frozenset(p for b in ENGLISH_VERBS if not (p := english_forms(b)["participle"]).endswith("ed"))

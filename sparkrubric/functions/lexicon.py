"""Word lists behind the diacritic and code-switch scores.

The lists are small literals, so the scoring expressions test membership with ``isin`` (a hash set inside the
scan stage) and need no join.  The English list beyond the function words is open-ended: it is built from base
words by regular inflection, and every scoring function takes the caller's own list instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrubric.functions import text as tx

# --- fixed values ------------------------------------------------------------------------------------------
# ASCII spelling : accepted Romanian spellings
VALID_SPELLINGS = """
    aceasta:aceasta|această acestea:acestea acesta:acesta alta:alta|altă asemenea:asemenea asa:așa
    asadar:așadar banca:banca|bancă bara:bara|bară casa:casa|casă catra:către catre:către cand:când
    cateva:câteva cativa:câțiva daca:dacă deasupra:deasupra dimineata:dimineața|dimineață doua:două|doua
    fara:fără fata:fata|fată|față grădina:grădina gradina:grădina inapoi:înapoi insa:însă intr:într
    intra:intra|intră masa:masa|masă miercuri:miercuri nevoie:nevoie oara:oară oras:oraș orasul:orașul
    oricare:oricare pana:până para:para|pară pastra:păstra peste:peste plata:plata|plată poate:poate
    poarta:poarta|poartă problema:problema|problemă putea:putea rama:rama|ramă ramane:rămâne romana:română
    romaneasca:românească romanesc:românesc saraca:săraca|săracă seara:seara|seară scoala:școala|școală
    spata:spata|spată strada:strada|stradă tara:țara|țară treaba:treaba|treabă vara:vara|vară
    vatra:vatra|vatră viata:viața|viață vineri:vineri vreodata:vreodată zambet:zâmbet zapada:zăpadă cat:cât
    cati:câți cate:câte cantec:cântec camp:câmp campul:câmpul castig:câștig castiga:câștiga|câștigă gand:gând
    gandul:gândul gandesc:gândesc gandire:gândire infrant:înfrânt invatamant:învățământ mantuit:mântuit
    mana:mâna|mână maine:mâine mancare:mâncare paine:pâine pamant:pământ parau:pârâu ramas:rămas rand:rând
    randul:rândul sangele:sângele sange:sânge sant:sfânt sfant:sfânt zambi:zâmbi zambesc:zâmbesc in:în
    inainte:înainte inalt:înalt inalta:înaltă incepe:începe incep:încep inceput:început incerca:încerca
    inchide:închide inchis:închis inca:încă incotro:încotro indrazni:îndrăzni insasi:însăși insusi:însuși
    intelege:înțelege inteles:înțeles intotdeauna:întotdeauna intreaba:întreabă intrebare:întrebare
    intreg:întreg intreaga:întreagă|întreaga invata:învăța|învață aseza:așeza cunostinta:cunoștință
    desigur:desigur stia:știa stie:știe stii:știi stim:știm stiinta:știință stiut:știut si:și usa:ușa|ușă
    usura:ușura usor:ușor usoara:ușoară sase:șase sapte:șapte saptamana:săptămână sarpe:șarpe
    sedinta:ședință|ședința sedintei:ședinței sefa:șefa sef:șef sosea:șosea soseaua:șoseaua aceștia:aceștia
    atata:atâta atatia:atâția atatea:atâtea functioneaza:funcționează imediat:imediat
    intelepciune:înțelepciune natiune:națiune natie:nație participanti:participanți situatie:situație
    tarile:țările tarii:țării taran:țăran tarani:țărani tel:țel tinut:ținut tinutul:ținutul tine:ține
    tinta:țintă tot:tot acestia:aceștia acela:acela aceea:aceea
"""

# Words whose ASCII spelling is never right; the lookup key is the word without its diacritics
REQUIRED_SPELLINGS = """
    și în așa dacă fără când însă încă după către decât încât totuși măcar așadar fiindcă cât câți câte câteva
    câțiva atât atâta atâția atâtea oricât oricând oricâți oricâte întâi mâine câteodată niciodată vreodată
    întotdeauna înainte înapoi marți sâmbătă începe încep început încerca încerc închide închis înveți
    înțelege înțeles întreb întreabă întrebare întâlnesc întâlnire întorc întoarce împotriva împreună încotro
    știe știi știu știm știți știut știință găsește gândește reușește trăiește urmărește lucrează așteaptă
    aștept așteptăm rămâne rămân faceți vreți puteți aveți sunteți spuneți vedeți luați dați stați auziți
    mergeți veniți citiți scrieți ești fiți țară țării țările oraș orașul orașe viață pâine gând gânduri mâini
    pământ săptămână săptămâni răspuns răspunsuri acasă afară părinți băiat băieți bărbat bărbați bătrân
    bătrâni ușor ușoară următorul următoarea următor șase șapte între înăuntru împrejur bineînțeles înțelegere
    înțelepciune însemnătate însemna însoți îndruma îngriji învăța însuși însăși înseși înșiși își însărcinat
    însărcinată înțelept înțeleaptă întreagă greșit românesc românească duminică dimineața aseară încearcă
    încercăm încercați înțelegem înțelegeți greșesc greșește prezintă păstrează hotărăște făcând știind
    gândind rămânând cântând părând având văzând căutând începând încercând înțelegând așteptând funcție
    condiție atenție tradiție poziție secție direcție acțiune mențiune excepție propoziție emoție promoție
    relația relație stația stație operație situația informația informație cuvânt cuvântul mașină mașinile
    greșeală încercare întâmplare cunoștință ființă privință tăcere război cântec cântece români româncă
    română franceză engleză germană niște aceștia cărui cărei cărora aș ați
"""

ENGLISH_STOPWORDS = """
    the a an and or but if then else is are was were be been being have has had having do does did doing will
    would shall should may might must can could this that these those i you he she it we they my your his her
    its our their what which who whom whose where when why how all each every both few more most other some
    such no nor not only own same so than too very just also now here there because although while unless
    until since about above across after against along among around before behind below beneath beside between
    beyond during except inside into near off onto outside over through toward under upon with within without
    however therefore furthermore moreover nevertheless for from of to by at on in as up out
"""

ENGLISH_WHITELIST = """
    ok weekend online email internet computer software marketing management design hotel restaurant taxi metro
    video audio tv radio film sport golf tennis fotbal fitness yoga pizza pasta menu nu de pe care este sunt
    era avea face vine merge place vor fi din cu la prin spre sub asupra mare mic bun nou alt tot ori am ai
    are au day day1 day2 day3 day4 day5 null true false
"""

ROMANIAN_LOOKALIKES = """
    nu de pe care este sunt era avea face vine merge place vor fi din cu la prin spre sub asupra mare mic bun
    nou alt tot ori am ai are au e a o un i le se ne te ma tu el ea noi voi ei ele ca sa si in ce cum cine mai
    dar sau nici deci doar chiar fost parte pentru foarte toate acum atunci aici acolo zile timp ani mod tip
    fire include peste start stop simple continue complete public rapid direct exact recent important special
    normal perfect modern original natural general central cultural actual final local total principal ideal
    real formal popular similar familiar particular regulat international national regional traditional
    personal professional social medical legal moral mental vocal vital fatal brutal rural urban program
    moment content plan transport restaurant monument element segment document argument instrument experiment
    apartament departament sentiment hotel model nivel material animal canal festival capital potential serial
    ritual manual jurnal tribunal minister profesor doctor director sector factor motor autor actor senator
    spectator calculator indicator an roman fond conflict contact contract impact aspect respect concept
    context text pretext reflex complex index prefix sufix cost vast test protest rest vest gust august robust
    just bust
"""

# The five short words of the quick check
CRITICAL_WORDS = "si in sa ca la"
# --- end of fixed values -----------------------------------------------------------------------------------

# Base words for the default English list; inflected forms are derived, see ``inflect``.
ENGLISH_VERB_STEMS = """
    want walk talk start help need work seem call ask visit explore enjoy recommend schedule allow ensure
    include require provide consider avoid arrange suit match explain suggest indicate offer create
    finish achieve reach follow list add remove assign allocate organize maintain play watch stay wait happen
    change believe remember learn receive turn move close experience
"""
ENGLISH_NOUN_STEMS = """
    thing year way day week hand place case question government number night point home room mother father
    student group country problem fact friend job house school teacher price meal game movie book song city
    town street door window side kind piece issue matter power light sound picture word letter page step
    answer reason heart head tree flower dog bird horse morning afternoon evening month person example
    benefit advantage priority option goal task item detail feature attraction itinerary destination museum
    castle park budget
"""
ENGLISH_PLAIN = """
    me us him them myself yourself himself herself itself ourselves themselves mine yours hers theirs
    get got go went gone come came see saw seen know knew known think thought make made find found give given
    tell told take taken keep kept good new first last great little old right big high small large next young
    better best sure free true full well even back still again never always often actually really probably
    maybe perhaps already almost enough quite rather whether something nothing everything anything someone
    people children today tomorrow yesterday please thanks beautiful happy easy difficult possible available
    overall basically additionally specifically generally regarding second third several various multiple
    another yet once indoor outdoor suitable friendly
"""

def strip_word(word: str) -> str:
    """Driver-side twin of ``text.strip_diacritics`` for building literal sets."""
    return word.translate(str.maketrans(tx.ACCENTED, tx.PLAIN))


def valid_spellings() -> dict[str, list[str]]:
    return {key: forms.split("|") for key, forms in (entry.split(":") for entry in VALID_SPELLINGS.split())}


def required_spellings() -> dict[str, str]:
    return {strip_word(word): word for word in REQUIRED_SPELLINGS.split()}


def inflect(verbs: str = ENGLISH_VERB_STEMS, nouns: str = ENGLISH_NOUN_STEMS) -> list[str]:
    """Regular English inflection: verbs take -s/-ed/-ing, nouns take the plural."""

    def plural(w: str) -> str:
        if w.endswith(("s", "x", "ch", "sh")):
            return w + "es"
        if w.endswith("y") and w[-2] not in "aeiou":
            return w[:-1] + "ies"
        return w + "s"

    out: list[str] = []
    for w in verbs.split():
        stem = w[:-1] if w.endswith("e") else w
        out += [w, plural(w), stem + "ed", stem + "ing"]
    for w in nouns.split():
        out += [w, plural(w)]
    return out


def default_english_words() -> list[str]:
    return list(dict.fromkeys(ENGLISH_PLAIN.split() + inflect()))


def english_words(extra: list[str] | None = None) -> list[str]:
    """Function words plus the high-confidence list; ``extra`` replaces the default high-confidence list."""
    high = default_english_words() if extra is None else extra
    exempt = set(exempt_words())
    return sorted({w for w in [*ENGLISH_STOPWORDS.split(), *high] if w not in exempt and strip_word(w) not in exempt})


def exempt_words() -> list[str]:
    return sorted(set(ROMANIAN_LOOKALIKES.split()) | set(ENGLISH_WHITELIST.split()))


def known_keys() -> list[str]:
    """Stripped spellings the diacritic check can judge."""
    return sorted(set(required_spellings()) | set(valid_spellings()))


def correct_words() -> list[str]:
    """Spellings counted as correct: the required one, or any valid one that the required list does not overrule."""
    must, valid = required_spellings(), valid_spellings()
    ok = set(must.values())
    for key, forms in valid.items():
        ok |= {f for f in forms if strip_word(f) == key and not (key in must and f == key)}
    return sorted(ok)


def assumed_keys() -> list[str]:
    """Keys with a required spelling but no list of valid ones: any accented spelling passes."""
    return sorted(set(required_spellings()) - set(valid_spellings()))


def expected_spelling() -> dict[str, str]:
    """Spelling shown beside a flagged word: the required one, else the first valid one that differs from ASCII."""
    out = {k: next((f for f in forms if f != k), forms[0]) for k, forms in valid_spellings().items()}
    out.update(required_spellings())
    return out


# --- dimension tables --------------------------------------------------------------------------------------
def diacritic_table(spark: SparkSession) -> DataFrame:
    """``(stripped, must, valid)``: one row per judgeable ASCII spelling."""
    must, valid = required_spellings(), valid_spellings()
    rows = [(k, must.get(k), valid.get(k)) for k in known_keys()]
    return spark.createDataFrame(rows, "stripped string, must string, valid array<string>")


def codeswitch_table(spark: SparkSession, high_confidence: list[str] | None = None) -> DataFrame:
    """``(word, class)`` with class high / stop / white / lookalike."""
    classes = {
        "high": default_english_words() if high_confidence is None else high_confidence,
        "stop": ENGLISH_STOPWORDS.split(),
        "white": ENGLISH_WHITELIST.split(),
        "lookalike": ROMANIAN_LOOKALIKES.split(),
    }
    rows = [(w, name) for name, words in classes.items() for w in dict.fromkeys(words)]
    return spark.createDataFrame(rows, "word string, class string")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """A caller's lexicon, one word per line, as ``(word)``; stays distributed."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()

"""Weighted finite-state grammar of abusive, hateful and sexually explicit clauses.

Words pass a lexicon transducer that undoes disguises (look-alike letters, invisible signs, spaced
or stretched letters, digits and stars for letters) and writes classes: insults, groups, bodies,
violence and so on.  Clause patterns over words and classes are finite automata with weights,
composed from insult, threat, group, sexual and put-down parts.  Negation and reported-speech
automata then lower the weight of a match.  A text scores as its matched clauses together:
1 - product of (1 - weight).

Single words score nothing: cursing at things, naming such subjects in class, medicine, law or
engineering, and rules against abuse match no pattern.

Defined results: a null or empty text scores 0.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

THRESHOLD = 0.5
NEAR = 6  # words around a match that may show talk about words

# Letters of other scripts that look like Latin ones, and signs used for letters.
LOOKALIKES = str.maketrans("аеорсхуіјѕԁһкмтвнпгοαενικρτυχѵԛԝɡı", "aeopcxyijsdhkmtbhnroaevikptuxvqwgi")
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e"}
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")

# The lexicon, by class.  Entries are in plain form: lower case, without accents.
LEXICON: dict[str, str] = {
    # persons: words that insult whoever they are said of
    "INS": """moron morons idiot idiots imbecile imbeciles cretin cretins scumbag scumbags jackass dumbass dipshit dickhead
        asshole assholes arsehole bastard bastards bitch bitches whore slut sluts loser losers twat wanker prick cunt
        cunts halfwit dimwit nitwit dumbo retard retards freak freaks creep creeps scum lowlife bonehead blockhead
        numskull motherfucker fucktard shithead pig pigs swine parasite parasites douchebag degenerate simpleton fool
        coward clown turd
        arschloch arschlocher vollidiot vollidioten idioten trottel depp deppen schlampe schlampen hurensohn hure wichser missgeburt
        versager schwachkopf dummkopf drecksau penner spast fotze vollpfosten blodmann
        gilipollas imbecil imbeciles idiota idiotas cabron cabrona cabrones puta putas puto zorra zorras pendejo pendeja
        subnormal hijoputa mamon capullo estupido estupida tonto inutil fracasado fracasada maricon payaso
        connard connards connasse salope salopes salaud pute putes abruti abrutis abrutie encule batard cretine debile
        ordure raclure rate ratee bouffon minable pouffiasse""",
    "BAD": """stupid brainless pathetic worthless useless filthy dirty ugly dumb lying disgusting vile rotten miserable
        spineless smelly fat lazy fucking bloody damn goddamn complete total utter absolute elender elende elendes
        dumme dummer blode bloder mieser miese dreckige dreckiger hassliche sale sales gros grosse petit pauvre
        maldito maldita asqueroso asquerosa puto jodido little old incompetent ignorant sorry half""",
    "BEAST": """cow pig rat clown dog worm snake monkey ape toad goat donkey cockroach vermin trash garbage witch
        bag brat sow waste piece excuse nobody wit hund sau kuh schwein ratte vache porc chien truie cerdo cerda perra perro rata vaca""",
    "VILE": """vermin scum trash garbage filth animals animal parasites parasite rats rat cockroaches subhuman subhumans savages
        pests disease plague cancer dirt barbarians monkeys apes pigs dogs abschaum ungeziefer dreck gesindel pack mull
        basura escoria plaga ratas alimanas animales mierda vermine ordures racaille parasiten parasitos pourriture""",
    "DULL": """stupid dumb dim slow thick lazy dirty inferior backward primitive weak blod dumm doof tontas tontos tonta tonto
        estupidas estupidos inutiles betes bete idiots stupides cons idiotes faul""",
    "GROUP": """women girls men boys immigrants immigrant foreigners migrants refugees gays lesbians homosexuals queers
        transsexuals jews muslims christians hindus buddhists atheists blacks whites asians africans arabs mexicans
        gypsies roma disabled deaf blind elderly villagers natives easterners northerners southerners peasants
        foreigner jew muslim catholics protestants
        auslander frauen madchen fluchtlinge migranten juden muslime schwule lesben behinderte behinderten zigeuner turken
        alten inmigrantes mujeres extranjeros refugiados judios musulmanes negros gays gitanos discapacitados viejos
        moros chicas etrangers femmes filles immigres refugies juifs musulmans noirs arabes handicapes vieux homosexuels""",
    "HURT": """kill killed murder murdered stab stabbed shoot shot beat beaten beats punch punched slap slapped strangle strangled
        hang hanged choke choked burn burned crush crushed smash smashed hurt cripple whip whipped kick kicked drown
        drowned hit rape raped lynch lynched gas gassed torture tortured execute executed behead poison run""",
    "BODY": """jaw face teeth neck nose legs arms bones skull head throat knees ribs fingers back skin eyes guts mouth""",
    "SEXWORD": """blowjob blowjobs handjob tits titties boobs dick dicks cock cocks pussy cunt cum orgasm orgasms masturbate masturbating
        masturbated horny porn porno nudes dildo anal threesome gangbang deepthroat erection boner clit
        nacktbilder nacktfotos schwanz titten ficken geile geil polla tetas follar cono bite couilles baiser nichons chatte
        slutty hookup milf""",
    "BARE": """naked nude nudes undressed topless nackt nackte nackten desnuda desnudo desnudas nue nu nues nus""",
    "PICTURE": """picture pictures photo photos pic pics video videos selfie selfies bilder fotos foto bild image images""",
    # adjectives that make a group of the word for people after them
    "GADJ": """old gay black white brown jewish muslim christian disabled deaf blind trans transgender queer lesbian poor
        homeless foreign asian african mexican arab indian chinese fat autistic indigenous""",
    "FOLK": "people folk folks men women persons kids couples students girls boys guys ones",
    "PERSON": """tutor lecturer teacher professor guy woman man girl boy boss manager recruiter student person instructor author
        colleague supervisor dean director examiner assistant interviewer speaker classmate neighbour staff poster moderator
        he she they""",
    "NOT": "not never no nobody none nothing neither isn't aren't don't doesn't didn't won't kein keine nicht nie no nunca jamas ne pas jamais",
    "SAYING": """terms word words slur slurs insult insults quote quoted quotes quotation lecture seminar module novel film
        chapter policy rules studies discusses describes defines definition example examples called tolerated forbidden
        prohibited banned reported complaint beleidigungen hassrede insultos insultes begriff wort palabra mot
        education counselling""",
    # what is done about such words
    "RULING": """banned forbidden prohibited disallowed unacceptable violates violate violation breaches sanctioned moderated
        verboten untersagt prohibido prohibida interdit interdite interdits""",
}
NEGATIONS = frozenset(LEXICON["NOT"].split())
# What may stand before a noun without changing whom it names.
FILL = "a an the this that these those such some so really very just only more most of to be is are und y et ein eine un une el la le les der die das los las"

# The grammar.  One pattern a line: weight, then items.  An item is a word, CLASS, or
# alternatives a|b; `?` makes it optional, `*` lets it repeat, ..n stands for up to n words of any kind.
GRAMMAR: dict[str, str] = {
    "insult": """
        0.9 you|u|ya are|r|re ..3 BAD* INS
        0.9 you|u are|r|re ..3 BAD BEAST
        0.9 you|u are|r ..2 waste|piece of space|shit|crap|trash|garbage
        0.9 youre|ur ..3 BAD* INS
        0.9 youre|ur ..3 BAD BEAST
        0.8 you|your|ya BAD* INS
        0.8 you|your|ya BAD BAD* BEAST
        0.8 you ..1 waste|piece of space|shit|crap
        0.8 BAD* INS like you|him|her|them|that
        0.8 BAD BEAST like you|him|her|them|that
        0.8 waste|piece of space|shit|crap like you|him|her
        0.8 PERSON ..8 is|was|are a|an|such|nothing|just ..3 BAD* INS
        0.8 PERSON ..8 is|was|are a|an|such ..3 BAD BEAST
        0.8 PERSON ..8 is|was a|an|such ..3 waste|piece of space|shit|crap
        0.8 who|which wrote|runs|teaches|made|posted|grades|said ..3 is|are a|an|such ..3 BAD* INS
        0.8 who|which wrote|runs|teaches|made|posted|grades|said ..3 is|are a|an|such ..3 BAD BEAST
        0.8 who|which wrote|runs|teaches|made|posted|grades|said ..3 is|are a|an|such ..3 waste|piece of space|shit
        0.8 the|this|that|some BAD* INS from|who|grades|opens|teaches|runs|wrote|should|deserves|can't|cannot|is|thinks
        0.8 the|this|that|some BAD BEAST from|who|grades|opens|teaches|runs|wrote|should|deserves|is|thinks
        0.8 the|this|that|some waste|piece of space|shit|crap from|who|grades|opens|teaches|runs|wrote|should|is
        0.7 BAD BEAST and a INS
        0.7 is|are a lying ..3
        0.8 brainless|worthless|pathetic|filthy BEAST|INS
        0.7 stupid BEAST
        0.8 shut your|ya|the mouth|face|trap|hole|fuck
        0.7 shut up ..1 you|INS
        0.8 go to hell ..1 you|INS
        0.8 rot|burn in hell
        0.7 crawl back under|into|to
        0.6 get lost before
        0.8 fuck you|off|yourself
        0.8 screw you
        0.7 you|u smell|stink|disgust|repulse
        0.7 mother|parents|father must be ashamed
        0.8 ashamed that you were born
        0.7 face|brain|body like yours|his|hers
        0.6 nobody|noone|none asked|likes|wants|needs|loves you
        0.8 not one|a person|soul would|will miss you
        0.7 world would|is be? better without you
        0.8 du ..3 bist|blode|dumme|elende ..4 INS
        0.8 du BAD* INS
        0.8 ihr seid ..3 INS
        0.8 halt die|deine|dein fresse|klappe|maul|schnauze
        0.7 keiner|niemand braucht|mag|will dich
        0.8 eres ..3 INS
        0.8 sois|es|est|etes un|une|des ..3 INS
        0.8 tu es ..4 INS
        0.8 vous etes ..4 INS
        0.8 callate|callaos ..1 INS|nadie
        0.7 nadie te quiere|aguanta|soporta
        0.8 ferme ta|la gueule|bouche
        0.8 ta gueule
        0.7 personne ne te|t supporte|aime|aimes
        0.8 va te faire foutre|voir
        0.8 vete a la mierda
        0.8 verpiss dich
        0.8 hijo|hija de puta
        0.8 fils de pute
        0.8 fick dich
        0.8 chinga tu madre
        0.7 espece de BAD* INS
        0.7 leck mich
        """,
    "threat": """
        0.9 i|we|ill will|ll|would|gonna|shall|wanna|am|m ..2 HURT ..1 you|u|him|her|them|your|his|their
        0.9 i|we|ill HURT you|u
        0.9 will|gonna|ll|ill break|smash|cut|knock|rip|bash ..1 your|his|her|their BODY
        0.9 break|smash|bash|knock|kick your|his|her|their ..1 BODY|car|door
        0.9 i|we will|ll|ill ..1 set|burn ..2 car|house|home|flat|desk|office on|down|fire
        0.9 set|burn their|your|his|her ..1 car|house|home on|down fire?
        0.9 you|they|he|she deserve|deserves to be|get HURT
        0.8 should|must|ought|needs|need to? be ..1 HURT|slapped|punched|whipped|gassed
        0.9 hope|wish ..1 somebody|someone|you|they|he|she ..2 HURT|die|dies|rot|suffer ..1 you|him|her|them|soon|alone|painfully|slowly|in
        0.9 hope you|they|he|she die|dies|rot|suffer
        0.9 teach you|him|her|them a lesson
        0.9 watch|mind your back
        0.9 know where you|he|she|they live|park|work|sleep
        0.9 jump|leap off ..4
        0.9 kill|hang|shoot|drown|cut yourself|urself|himself|herself|themselves
        0.9 delete your|ur account|life
        0.9 and your life with it
        0.8 favour|favor and disappear|die|jump|vanish
        0.8 rest of us will|would cheer|celebrate|laugh
        0.8 drop dead
        0.8 you will|ll|are pay|regret|bleed|suffer|die|dead
        0.8 you re|are dead|finished meat?
        0.9 if you|i ..8 will|ll HURT|break|smash|cut you|your
        0.9 ich|wir schlage|schlag|haue|hau|breche|trete|prugle|steche|bringe|bring|mache ..1 dir|dich|euch ..4
        0.9 ich|wir werde|werden|will|wollen dich|dir|euch ..4 umbringen|toten|schlagen|verprugeln|brechen|abstechen
        0.9 bringe|bring dich um
        0.9 te|os|le voy|vamos|va a ..1 partir|romper|matar|reventar|pegar|dar|hacer|destrozar
        0.9 te mato|matare|rompo|parto|reviento
        0.9 je|on vais|va|vas te|vous|lui casser|tuer|frapper|defoncer|eclater|peter|demolir|crever|buter|exploser
        0.9 je te tue|crève|creve|defonce|casse
        """,
    "group": """
        0.9 GROUP ..4 are|is|be ..2 VILE
        0.9 GROUP ..6 are|is too|so|simply|just ..1 DULL
        0.9 GROUP people? are|is DULL
        0.9 people|ones|those|lot|kind|gays of|from|with ..4 are|is ..2 VILE|dirty|thieves|criminals
        0.9 people|ones|those of|from|with ..4 are|is too|so|simply|just DULL
        0.8 GROUP|people ..5 belong|belongs in|on|under ..1 gutter|kitchen|cage|cages|zoo|ghetto|camp|camps|prison|jail|grave|sewer|bin|street|swamp|jungle|ovens|ground|dirt
        0.9 not|never|hardly|barely ..1 fully|really|even human|people
        0.9 nobody|noone wants|needs|likes ..1 GROUP
        0.9 nobody|noone wants|needs|likes ..2 people of|with|from
        0.9 keep ..1 GROUP away|out|off
        0.9 keep ..3 people|ones ..5 away|out
        0.9 makes|make me sick
        0.9 let them|em rot|die|starve|drown|burn
        0.9 i|we hate|despise|detest|loathe ..1 GROUP
        0.9 i|we hate|despise|detest ..2 people of|with|from
        0.9 clean|nice|safe|fine|better before they|those|these came|arrived|moved
        0.9 why do|did they let ..1 GROUP
        0.9 why do|did they let ..2 people of|with|from
        0.9 do|does|will not|never|dont hire|employ|serve|want|admit ..1 GROUP
        0.9 do|does|will not|never hire|employ|serve|admit ..2 people of|with|from
        0.9 they are ..1 dirty|thieves|vermin|animals|filthy|VILE
        0.9 dirty|lazy|filthy and they steal|lie|stink|cheat
        0.9 no loss if ..10
        0.9 whole lot of ..5 were|was ..1 HURT|gone|deported|dead
        0.9 their|this|that kind|sort ..1 breed|breeds|multiply|multiplies|ruins|stinks
        0.9 ruin|ruins every street|place|town|neighbourhood
        0.9 filthy|dirty lot|bunch|people
        0.9 send|throw|kick|ship|drive|deport ..1 them|GROUP ..2 away|out|back|off|home
        0.9 deport|gas|exterminate|eradicate|lynch|shoot ..2 GROUP|them
        0.9 GROUP ..4 should|must|ought|deserve ..3 deported|gassed|HURT|banned|kept|removed|eliminated|die
        0.9 GROUP ..3 sind|ist ..8 VILE|DULL
        0.9 GROUP ..3 son ..6 VILE|DULL
        0.9 GROUP ..3 sont ..6 VILE|DULL
        0.8 alle|alles rausgeworfen|rauswerfen|abschieben|vergasen|weg|abgeschoben
        0.8 GROUP raus
        0.8 echarlos|expulsarlos|matarlos|fusilarlos ..2
        0.8 fuera ..1 GROUP
        0.8 qu on|il les ..1 chasse|expulse|vire|renvoie|pende|jette
        0.8 dehors ..1 GROUP
        """,
    "sexual": """
        0.9 send|show|give|mail|want ..2 BARE PICTURE
        0.9 BARE PICTURE of you|yourself|her|him
        0.9 send|show|mail ..2 nudes
        0.9 PICTURE ..3 BARE
        0.9 strip|undress for me|us|him|her
        0.9 moan|moaning|scream my|his|her name
        0.9 sex tape|tapes|toy|toys|cam|slave
        0.9 hard|hot|rough|oral|anal|wild|kinky|dirty sex
        0.9 looking for|up a ..1 hookup
        0.9 hookup ..6 sex|tonight
        0.9 have|having|had|want|wants|wanted sex there|with|in|on|now|tonight
        0.9 horny ..2 adults|girls|women|men|boys|singles|housewives|student|students|teacher
        0.9 wanted|gave|got|give|giving|gets|get|want a|me|him|her ..1 blowjob|handjob
        0.9 blowjob|handjob|gangbang|deepthroat|cumshot ..1
        0.9 huge|big|great|nice|firm|perfect|sexy|hot ..1 tits|boobs|titties|ass|arse|cock|dick|breasts|pussy
        0.9 bang|fuck|shag|screw|hump her|him|them ..3
        0.9 rub|rubs|rubbed|rubbing|stroke|stroking|grab|grabbed|suck|sucking|lick|licking ..1 his|her|my|your dick|cock|pussy|clit|tits|boobs|balls|nipples|penis
        0.9 his|my|your|her dick|cock|pussy|tits|boobs|clit ..4
        0.9 suck|lick|ride|eat my|his|your|her ..1
        0.8 getting|get|got|see|seeing|imagine|imagining|want ..6 BARE on|in|and|under|over ..5 bed|desk|sex|shower|couch|floor|table
        0.9 BARE ..6 having|have|had sex
        0.8 hands ..6 under ..1 that|your|her|his|the blouse|skirt|shirt|dress|bra|trousers|pants|clothes
        0.8 come to my room|bed|place ..4
        0.8 take it|them|everything|your clothes? off ..2
        0.8 body like hers|his|yours ..6 good ..10
        0.8 good for one thing ..6 bed
        0.8 happens in bed
        0.9 fuck me ..2
        0.9 cum|come|masturbate|masturbating|jerk|wank on|over|in|inside|off|to ..2 your|her|his|my|you|me
        0.9 schick|schicke|zeig|zeige|sende ..2 nacktbilder|nacktfotos|BARE|titten
        0.9 du ..2 geile|geiles|geiler ..2
        0.9 nacktbilder|nacktfotos ..3 geile|schlampe|dir
        0.9 mandame|enviame|ensename|pasame|muestrame ..3 BARE|tetas|culo|cono|nudes
        0.9 envoie|montre|envoi moi ..6 BARE|seins|nichons|fesses|chatte|cul
        0.9 envoie|montre ..2 moi ..6 BARE
        0.9 quiero|voy a follar ..2
        0.9 te quiero|voy follar|coger
        0.9 will|willst|mochte|werde dich ..1 ficken|bumsen
        0.9 veux|vais te|la baiser|sauter|niquer
        """,
}


def plain(text: str) -> str:
    """Lower case without accents, invisible signs or look-alike letters."""
    if text.isascii():
        return text.lower()
    text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).casefold().translate(LOOKALIKES)
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    return text.translate({ord(c): None for c in set(text) if unicodedata.combining(c)})


CLAUSE = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|[\r\n]+|;\s")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*])[^\W_])(?:\1[^\W_]){1,}(?![^\W_])")
WORD = re.compile(r"[^\W_][\w*@$!€']*[\w*]|[^\W_]", re.U)
HYPHENED = re.compile(r"[^\W_]+-[\w*@$!]+")
# Words outside the lexicon that are written with stars.
STARRED = ("hate", "fuck", "shit", "fucking", "sex", "piece", "waste", "space", "hell", "steal", "human")
# Words of four letters and more that any text is full of.
COMMON = frozenset("that this with from they them will your have what when there their would should could about which people like then than into over know want like need these those some such just only very".split())
STRETCH = re.compile(r"(.)\1{2,}")
RUN = re.compile(r"(.)\1+")


class Lexicon:
    """The word transducer: a word as written to its plain form and its classes."""

    def __init__(self, lexicon: dict[str, str], words: set[str]):
        self.classes: dict[str, frozenset[str]] = {}
        for label, entries in lexicon.items():
            for w in entries.split():
                self.classes[w] = self.classes.get(w, frozenset()) | {label}
        self.known = set(self.classes) | words
        self.squeezed: dict[str, str] = {}
        for w in sorted(self.known):
            self.squeezed.setdefault(RUN.sub(r"\1", w), w)
        self.shape: dict[tuple[str, str, int], list[str]] = {}
        for w in sorted(self.classes):
            if len(w) > 2:
                self.shape.setdefault((w[0], w[-1], len(w)), []).append(w)
        self.rude = {w for w, c in self.classes.items() if c & {"INS", "BAD", "BEAST", "VILE", "DULL", "SEXWORD", "BARE", "HURT"}} | {
            "fuck", "shit", "fucking", "sex", "ass", "arse", "waste", "piece", "bang", "crap",
        }

    @lru_cache(maxsize=200_000)
    def read(self, word: str) -> tuple[str, ...]:
        """The known words that may be meant, else the word itself."""
        if word in self.known:
            return (word,)
        if "*" in word:
            body = word.strip("'")
            if body[0] != "*":
                pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in body))
                plainer = [w for w in STARRED if pattern.fullmatch(w)]
                may = [w for w in self.shape.get((body[0], body[-1], len(body)), []) if w in self.rude and pattern.fullmatch(w)]
                if plainer or may:
                    return tuple(dict.fromkeys(plainer + may))
            return (word.replace("*", ""),)
        tries = [word]
        if any(c in SIGNS for c in word) and any(c.isalpha() for c in word):
            tries.append("".join(SIGNS.get(c, c) for c in word))
            tries.append("".join("l" if c == "1" else SIGNS.get(c, c) for c in word))
        for t in tries[1:]:
            if t in self.known:
                return (t,)
        for t in tries:
            t = t.rstrip("!'")
            if t in self.known:
                return (t,)
            if STRETCH.search(t) and (w := self.squeezed.get(RUN.sub(r"\1", t))):
                return (w,)
        return (word,)

    @lru_cache(maxsize=200_000)
    def halves(self, word: str) -> tuple[str, str] | None:
        """Two rude words, or an article and one, written as one."""
        if word[0] in "ai" and (word[1:] in self.rude):
            return word[0], word[1:]
        for k in range(3, len(word) - 2):
            if word[:k] in self.rude and word[k:] in self.rude:
                return word[:k], word[k:]
        return None

    def labels(self, word: str) -> frozenset[str]:
        return self.classes.get(word, frozenset())


class Automaton:
    """A pattern as a finite automaton; `run` gives the end of the longest match from a start."""

    def __init__(self, kind: str, weight: float, items: list[str]):
        self.kind, self.weight = kind, weight
        self.arcs: list[list[tuple[frozenset[str] | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        state = 0
        for item in items:
            if item.startswith(".."):
                for _ in range(int(item[2:])):
                    new = self._state()
                    self.arcs[state].append((None, new))
                    self.skips[state].append(new)  # each further word may be left out
                    state = new
                continue
            optional, star = item.endswith("?"), item.endswith("*")
            names = frozenset(item.rstrip("?*").split("|"))
            if star:
                self.arcs[state].append((names, state))
                continue
            new = self._state()
            self.arcs[state].append((names, new))
            if optional:
                self.skips[state].append(new)
            state = new
        self.final = state
        self.needs = [frozenset(i.split("|")) for i in items if not i.startswith("..") and i[-1] not in "?*"]
        self.negated = any("NOT" in names or names & NEGATIONS for names in self.needs)
        self.first = self._closure({0})
        self.starts = frozenset(n for s in self.first for names, _ in self.arcs[s] if names for n in names)

    def _state(self) -> int:
        self.arcs.append([])
        self.skips.append([])
        return len(self.arcs) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def run(self, symbols: list[frozenset[str]], at: int) -> int:
        """End of the shortest match that starts at a word, or -1."""
        states = self.first
        for k in range(at, len(symbols)):
            nxt = {t for s in states for names, t in self.arcs[s] if names is None or names & symbols[k]}
            if not nxt:
                return -1
            states = self._closure(nxt)
            if self.final in states:
                return k + 1
        return -1


class Grammar:
    """All patterns, indexed by the words and classes they start with.

    A pattern is tried on a clause only if the clause holds its telling item: of the items it cannot do
    without, the one that common talk holds least."""

    def __init__(self, grammar: dict[str, str] = GRAMMAR, lexicon: dict[str, str] = LEXICON):
        self.patterns = []
        words: set[str] = set()
        for kind, lines in grammar.items():
            for line in lines.strip().splitlines():
                weight, *items = line.split()
                self.patterns.append(Automaton(kind, float(weight), items))
                words |= {n for i in items if not i.startswith("..") for n in i.rstrip("?*").split("|") if n.islower()}
        self.lexicon = Lexicon(lexicon, words)
        self.by_start: dict[str, list[int]] = {}
        self.by_telling: dict[str, list[int]] = {}
        for k, p in enumerate(self.patterns):
            for name in p.starts:
                self.by_start.setdefault(name, []).append(k)
            telling = min(p.needs, key=lambda names: (max(map(self._commonness, names)), sum(map(self._commonness, names)) / len(names), sorted(names)))
            for name in telling | ({"FOLK"} if "GROUP" in telling else set()):  # people may be a group by the word before
                self.by_telling.setdefault(name, []).append(k)
        self.tokens: dict[str, tuple[frozenset[int], tuple[frozenset[str], ...]]] = {}

    @staticmethod
    def _commonness(name: str) -> int:
        if name.isupper():
            return {"PERSON": 9, "NOT": 9, "FOLK": 8, "SAYING": 7, "GROUP": 6, "HURT": 3}.get(name, 2)
        return 9 if len(name) < 4 or name in COMMON else 4 if len(name) < 6 else 1

    def token(self, w: str) -> tuple[frozenset[int], tuple[frozenset[str], ...]]:
        """The patterns whose telling item a token is, and for each word that it stands for what
        patterns read: the words it may be and their classes."""
        symbols = tuple(frozenset().union(r, *(self.lexicon.labels(x) for x in r)) for r in self._readings(w))
        got = frozenset(k for s in symbols for n in s for k in self.by_telling.get(n, ())), symbols
        if len(self.tokens) < 500_000:
            self.tokens[w] = got
        return got

    def _readings(self, w: str) -> list[tuple[str, ...]]:
        r = self.lexicon.read(w)
        if r != (w,) or w in self.lexicon.known:
            return [r]
        if "'" in w:
            return [self.lexicon.read(x) for x in w.split("'") if x]
        if len(w) > 3 and (two := self.lexicon.halves(w)):
            return [(x,) for x in two]
        return [r]

    def _joined(self, m: re.Match) -> str:
        """A hyphened word without its hyphen if that is a word of the lexicon."""
        run = m.group().replace("-", "")
        return run if any(self.lexicon.labels(w) for w in self.lexicon.read(run)) else m.group()

    def clause(self, clause: str) -> list[tuple[str, float]]:
        """(kind, weight) of the best match of each kind in one plain clause."""
        known, token = self.tokens.get, self.token
        found = [known(w) or token(w) for w in WORD.findall(clause)]
        telling = [f for f, _ in found if f]
        if not telling:
            return []
        may = frozenset().union(*telling)
        symbols = [s for _, own in found for s in own]
        for k in range(len(symbols) - 1):
            if "GADJ" in symbols[k] and "FOLK" in symbols[k + 1]:
                symbols[k] |= {"GROUP"}
                symbols[k + 1] |= {"GROUP"}
        best: dict[str, float] = {}
        for at, s in enumerate(symbols):
            for name in s:
                for k in self.by_start.get(name, ()):
                    if k in may and (p := self.patterns[k]).weight > best.get(p.kind, 0) and (end := p.run(symbols, at)) > 0:
                        best[p.kind] = max(best.get(p.kind, 0), p.weight * self._context(p, symbols, at, end))
        return [(k, w) for k, w in best.items() if w > 0]

    @staticmethod
    def _context(pattern: Automaton, symbols: list[frozenset[str]], at: int, end: int) -> float:
        """What negation of a match and talk about words around it leave of its weight.

        Negation stands inside a match or, of what someone does or asks for, right before it; patterns that
        are themselves negated ("nobody wants ...") are left alone.  A rule or report on what is said
        lowers every kind; words of teaching and quoting lower insults and explicit talk only, as
        threats and hate are voiced in class and in quotes of one's own words, too."""
        factor = 1.0
        doing = pattern.kind in ("threat", "sexual")
        if not pattern.negated and "NOT" not in symbols[at] and any("NOT" in symbols[k] for k in range(max(0, at - 2) if doing else at + 1, end - 1)):
            factor *= 0.3
        around = [*range(max(0, at - NEAR), at), *range(end, min(len(symbols), end + NEAR))]
        if any("RULING" in symbols[k] for k in around) or (pattern.kind in ("insult", "sexual") and any("SAYING" in symbols[k] for k in around)):
            factor *= 0.3
        return factor

    def score(self, text: str | None) -> tuple[float, str]:
        """Score of a text and the kind of its heaviest clause (empty if nothing matched)."""
        if not text:
            return 0.0, ""
        miss, top, kind = 1.0, 0.0, ""
        seen: dict[str, list[tuple[str, float]]] = {}
        text = SPACED.sub(lambda m: m.group().replace(m.group(1), ""), plain(text))
        for clause in CLAUSE.split(HYPHENED.sub(self._joined, text)):
            if not clause:
                continue
            if (got := seen.get(clause)) is None:
                got = seen[clause] = self.clause(clause)
                for k, w in got:
                    miss *= 1 - w
                    if w > top:
                        top, kind = w, k
        return 1 - miss, kind

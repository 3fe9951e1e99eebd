"""Sentences with known labels from which the classifier starts, and the words that obfuscated spellings are matched with.

They are built from word lists and from common sentence frames of each language, without a look at any corpus: what a
corpus says in its own way is learned from its labels. They are offensive because what they must find is.
"""

from __future__ import annotations

from itertools import product

#: Words that disguised spellings are resolved to.
DISGUISED = frozenset(
    """idiot idiots moron morons imbecile cretin retard bitch bitches bastard bastards asshole assholes arsehole jerk wanker prick twat cunt cunts
    fuck fucks fucked fucker fuckers fucking motherfucker shit shits shithead bullshit crap piss pissed scum scumbag vermin whore whores slut sluts skank hooker
    dick dicks dickhead cock cocks pussy pussies tits boobs nude nudes naked porn porno sex sexy horny cum dildo anal blowjob nigger nigga faggot fag dyke tranny
    kill die rape stupid dumb loser losers trash garbage worthless useless pathetic hell damn ass arse
    arschloch hurensohn fotze schlampe wichser ficken fick scheiße scheisse vollidiot dreckskerl missgeburt abschaum
    connard connasse salope pute putain merde enculé encule baiser bite couilles crétin
    puta puto mierda cabrón cabron gilipollas imbécil imbecil follar polla coño zorra maricón pendejo
    сука блядь блять хуй пизда ебать мудак тварь мразь шлюха урод идиот дебил""".split()
)

#: By language: insults, adjectives of contempt, frames that turn an insult on a person.
_INSULTS = {
    "en": (
        "idiot|moron|bitch|bastard|asshole|cretin|imbecile|cunt|whore|dickhead|scumbag|loser|wanker|prick|piece of shit|son of a bitch|motherfucker|slut|retard|pig|maggot",
        "stupid|dumb|pathetic|worthless|disgusting|filthy|ugly|miserable|brainless|lying|useless|spineless",
        "you {adj} {noun}|you are nothing but a {adj} {noun}|you fucking {noun}|what a {adj} {noun} you are|he called her a {adj} {noun} to her face and meant it|get lost you {noun}|you really are a {noun}|listen {noun} nobody asked you|nobody likes you {noun}|{noun} like you should be fired",
    ),
    "de": ("arschloch|idiot|vollidiot|hurensohn|wichser|schlampe|missgeburt|dreckskerl|schwein|penner", "dummes|blödes|dreckiges|verdammtes|widerliches|faules", "du {adj} {noun}|du bist ein {adj} {noun}|verschwinde du {noun}|was bist du nur für ein {noun}|halt den mund du {adj} {noun}"),
    "fr": ("connard|salope|crétin|enculé|abruti|ordure|imbécile|pute|débile|porc", "sale|pauvre|gros|petit|espèce de", "{adj} {noun}|tu es un {adj} {noun}|dégage {noun}|ferme la {adj} {noun}|quel {adj} {noun} tu fais"),
    "es": ("imbécil|cabrón|gilipollas|idiota|puta|zorra|pendejo|basura|cerdo|hijo de puta", "maldito|sucio|pobre|estúpido|asqueroso", "eres un {adj} {noun}|{adj} {noun}|lárgate {noun}|cállate {adj} {noun}|qué {noun} eres"),
    "ru": ("идиот|урод|мудак|тварь|дебил|сука|мразь|придурок|скотина|козёл", "тупой|жалкий|грязный|проклятый|мерзкий", "ты {adj} {noun}|какой же ты {noun}|заткнись {adj} {noun}|пошёл вон {noun}|да ты просто {noun}"),
    "ja": ("バカ|クズ|ゴミ|間抜け|ブス|キモい奴|能無し", "この|お前は|本当に|ただの", "{adj}{noun}だ|{adj}{noun}消えろ|{adj}{noun}黙れ|{adj}{noun}死ね"),
}
_THREATS = {
    "en": ("kill|hurt|shoot|stab|beat|strangle|crush|burn|destroy", "i will {v} you|i am going to {v} you and your family|i should {v} you right now|somebody ought to {v} you|i will come to your house and {v} you|one day i will {v} you for this|you deserve to die|go and die|i hope you get cancer|you had better watch out i know your address|do the world a favour and hang yourself|go hang yourself|you will pay for this with blood"),
    "de": ("töten|schlagen|umbringen|verprügeln|erschießen", "ich werde dich {v}|man sollte dich {v}|ich komme vorbei um dich zu {v}|ich hoffe du stirbst|häng dich auf|ich mach dich fertig"),
    "fr": ("tuer|frapper|massacrer|écraser|égorger", "je vais te {v}|on devrait te {v}|je viendrai te {v} chez toi|j'espère que tu vas crever|va te pendre|crève"),
    "es": ("matar|golpear|destrozar|rajar|quemar", "te voy a {v}|habría que {v} a gente como tú|voy a ir a tu casa a {v} te|ojalá te mueras|muérete ya|ahórcate"),
    "ru": ("убью|зарежу|сломаю|уничтожу|задушу", "я тебя {v}|приду и {v} тебя|скоро я тебя {v}|чтоб ты сдох|сдохни|повесься"),
    "ja": ("殺す|殴る|刺す|潰す", "お前を{v}|いつか{v}ぞ|死んでくれ|くたばれ"),
}
_HATE = {
    "en": (
        "immigrants|foreigners|refugees|migrants|gypsies|jews|muslims|christians|blacks|arabs|asians|gays|lesbians|trans people|women|disabled people|poor people|these people|that tribe|their race",
        "vermin|rats|parasites|animals|scum|filth|a disease|subhuman|criminals|a plague|savages|cockroaches|dirt|stupid by nature",
        "{group} are {low}|all {group} are {low}|i hate {group} they are {low}|get rid of {group}|{group} should be locked up|{group} ruin every place they go|deport all {group}|gas the {group}|kill all {group}|no decent person wants {group} around|{group} are born {low}|{group} don't deserve rights|{group} smell and steal|we don't want {group} here|{group} are inferior to us|keep our town clean of {group}",
    ),
    "de": ("ausländer|flüchtlinge|juden|muslime|zigeuner|schwule|frauen", "ungeziefer|ratten|abschaum|parasiten|dreck|tiere", "{group} sind {low}|alle {group} sind {low}|{group} gehören vergast|wir wollen hier keine {group}|{group} raus"),
    "fr": ("étrangers|immigrés|juifs|musulmans|gitans|homosexuels|femmes", "rats|parasites|ordures|animaux|une maladie|des sous-hommes", "les {group} sont des {low}|tous les {group} sont des {low}|dehors les {group}|on ne veut pas de {group} ici|il faut éliminer les {group}"),
    "es": ("inmigrantes|extranjeros|judíos|musulmanes|gitanos|maricones|mujeres", "ratas|parásitos|basura|animales|escoria|una plaga", "los {group} son {low}|todos los {group} son {low}|fuera {group}|no queremos {group} aquí|hay que eliminar a los {group}"),
    "ru": ("мигранты|приезжие|евреи|мусульмане|цыгане|геи|бабы", "крысы|паразиты|мусор|животные|нелюди|зараза", "{group} это {low}|все {group} {low}|гнать {group}|ненавижу {group}|{group} не люди"),
    "ja": ("外国人|移民|女|障害者|あの民族", "ゴミ|害虫|寄生虫|劣等|汚物", "{group}は{low}だ|{group}はみんな{low}|{group}は出て行け|{group}は人間じゃない"),
}
_SEX = {
    "en": ("cock|dick|pussy|ass|tits|cunt", "i want to suck your {part}|let me lick your {part}|show me your {part}|she spread her legs and took his {part}|he came all over her {part}|fuck me hard|i am so wet and horny for you|take off your clothes and touch yourself|i want you naked in my bed|send a nude picture of yourself|naked girls fucking on camera|free hardcore porn videos|hot amateur sex clips|his hand slid into her panties|she was naked and moaning beneath him|i dream of your naked body on top of me|i masturbate thinking about you|live nude webcam girls waiting for you|watch horny teens get fucked|cum inside me|their tongues met as he unhooked her bra and squeezed her breasts|she gave him a blowjob|are you hard for me"),
    "de": ("schwanz|muschi|arsch|titten", "ich will deinen {part} lecken|zeig mir deine {part}|fick mich|ich will dich nackt sehen|schick mir nacktbilder|ich bin so geil auf dich|gratis pornos mit geilen frauen"),
    "fr": ("bite|chatte|cul|seins", "je veux te lécher la {part}|montre moi ta {part}|baise moi|je te veux nue dans mon lit|envoie une photo de toi nue|j'ai envie de te baiser|vidéos porno gratuites"),
    "es": ("polla|coño|culo|tetas", "quiero chuparte la {part}|enséñame tu {part}|fóllame|te quiero desnuda en mi cama|mándame una foto desnuda|tengo ganas de follarte|vídeos porno gratis"),
    "ru": ("член|киску|задницу|грудь", "хочу твой {part}|покажи {part}|трахни меня|хочу тебя голую|пришли голую фотку|порно бесплатно"),
    "ja": ("おっぱい|ちんこ|まんこ", "{part}を見せて|{part}を舐めたい|裸の写真を送って|今すぐやりたい|無修正エロ動画"),
}
#: Harmless uses of the same words, and sentences of everyday work.
_HARMLESS = """the idiot by dostoevsky is on the reading list
he played the bastard king in the school theatre
the term bastard sword describes a long medieval weapon
this is a pain in the neck but not your fault
damn it rained all day
shit i forgot my keys again
oh hell the train is late
i feel stupid for asking
i am such an idiot i left the lights on
what a stupid mistake of mine
the kill switch stops the engine
press ctrl c to kill the running task
the zombie process was killed by its parent
the master branch was renamed and the slave replica promoted
the shooting of the film starts in june
a shot of espresso costs two euros
the deadline nearly killed me
fire drill at noon please leave the building
the bomb disposal museum is open
rats and mice are kept in the laboratory
pest control found cockroaches in the basement
parasites of salmon are a problem for farmers
the plague of the fourteenth century changed europe
the animals were moved to the new shelter
immigrants founded many of the companies in this region
the refugees found work in the bakery
our women's team won the cup
the gay choir sings on saturday
jews and muslims celebrated together
the museum of black history opens in may
equal rights for disabled people are law
he dislikes foreigners is a sentence from the novel we discuss
hate speech is forbidden by the house rules
report any harassment to the ombudsman
the breast of the bird is yellow
chicken breast with rice is served today
breast cancer screening takes place in room four
the sex of the chicks is determined after hatching
sex education is part of the biology course
the clinic offers sexual health advice
naked mole rats live under the ground
the naked eye can't see it
virgin wool and virgin oil are sold here
the cock crowed at dawn
moby dick is a long novel
dick and jane visited the office
the pussy willow is in bloom
blue tits and great tits nest in the garden
the ass carried the bags up the hill
hooker's green is a pigment
the anal fin of the fish is long
the bitch had five puppies
the witch is dead is a song
the prick of the needle hardly hurts
a stiff joint needs oil
the hard drive is full
come over for dinner tonight
see you in bed four of the ward
touch the screen to start
take off your shoes at the door
her dress was made of silk
i want to see you in my office at nine
you are the best colleague one can have
you are not invited to this call by mistake
you were right about the numbers
i know your address from the old list
you should watch out for ice on the steps
we will crush the competition next year
beat the eggs and burn the sugar slightly
the virus infects plants only
das arschleder der bergleute hängt im museum
der schwanz des hundes wedelt
die ratten im labor sind gesund
frauen und männer verdienen das gleiche
die flüchtlinge lernen deutsch
verdammt das ist schon wieder kaputt
la chatte a eu quatre petits
la bite d'amarrage du port est rouillée
les étrangers sont les bienvenus
merde j'ai oublié le dossier
las mujeres y los hombres trabajan juntos
la gata parió cuatro gatitos
los inmigrantes abrieron una panadería
mierda he perdido el tren
собака родила щенков
мигранты открыли пекарню
чёрт опять забыл ключи
ゴミは火曜日に出してください
害虫駆除の業者が来ます
女の子が生まれました
please send the signed contract back
could you check the attached figures
the meeting was moved to thursday afternoon
thank you for your quick help yesterday
we need two more chairs for the workshop
the invoice for march is still open
i will be on holiday next week
the printer on the second floor is out of paper
let me know if the date suits you
the delivery arrived this morning
many thanks and kind regards
this mail and its attachments are confidential
if you are not the intended recipient please delete it
please consider the environment before printing
the draft of the report is in the shared folder
we agreed on a price of forty euros each
who can take over the shift on friday
the weather was fine and we walked to the lake
bitte senden sie mir die unterlagen
vielen dank für ihre schnelle antwort
die besprechung findet am montag statt
anbei erhalten sie die rechnung
merci pour votre réponse rapide
la réunion est reportée à mardi
veuillez trouver ci-joint la facture
gracias por su respuesta
la reunión se aplaza al martes
adjunto la factura de marzo
спасибо за быстрый ответ
встреча переносится на вторник
высылаю счёт за март
ご確認をお願いします
会議は火曜日に変更になりました
請求書を添付します""".split("\n")

#: Harmless sentences about the groups of _HATE.
_PEACE = {
    "en": "{group} are welcome here|{group} have the same rights as anyone|many {group} live in our street|we met {group} at the festival|the law protects {group}|{group} asked for a new bus stop|{group} and their families visited the museum|a novel about {group} won the prize|there is no reason to fear {group}|{group} are good neighbours",
    "de": "{group} sind willkommen|viele {group} leben in unserer straße|{group} haben dieselben rechte",
    "fr": "les {group} sont les bienvenus|beaucoup de {group} vivent ici|les {group} ont les mêmes droits",
    "es": "los {group} son bienvenidos|muchos {group} viven aquí|los {group} tienen los mismos derechos",
    "ru": "{group} живут в нашем доме|{group} имеют те же права",
    "ja": "{group}を歓迎します|{group}にも同じ権利があります",
}


def _spread(every: list[str], most: int) -> list[str]:
    """At most so many, evenly spread."""
    step = max(1, -(-len(every) // most))
    return every[::step]


def _filled(frames: str, most: int, **slots: str) -> list[str]:
    out = []
    for frame in frames.split("|"):
        own = [s for s in slots if "{" + s + "}" in frame]
        out += _spread([frame.format(**dict(zip(own, v))) for v in product(*(slots[s].split("|") for s in own))], most)
    return out


def labelled() -> list[tuple[str, int]]:
    """Sentences with 1 for abusive, hateful and sexual ones, 0 for harmless ones."""
    bad = []
    for nouns, adjectives, frames in _INSULTS.values():
        bad += _filled(frames, 24, noun=nouns, adj=adjectives)
    for verbs, frames in _THREATS.values():
        bad += _filled(frames, 9, v=verbs)
    for groups, low, frames in _HATE.values():
        bad += _filled(frames, 24, group=groups, low=low)
    for parts, frames in _SEX.values():
        bad += _filled(frames, 6, part=parts)
    good = [x for language, frames in _PEACE.items() for x in _filled(frames, 12, group=_HATE[language][0])]
    return [(s, 1) for s in dict.fromkeys(bad)] + [(s, 0) for s in [*_HARMLESS, *dict.fromkeys(good)]]

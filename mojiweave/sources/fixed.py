"""Fixed values that results depend on: characters, kana, dictionary, seeds, study words, parameters."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: character classes ---
BINDING = "._-+#@/:"
HARD = ",;!?。、！？"
NEUTRAL = "()[]{}\"'"

# --- fixed values: romaji and kana ---
KANA_TEXT = """
kya きゃ kyu きゅ kyo きょ gya ぎゃ gyu ぎゅ gyo ぎょ
sha しゃ shu しゅ sho しょ sya しゃ syu しゅ syo しょ
ja じゃ ju じゅ jo じょ jya じゃ jyu じゅ jyo じょ zya じゃ zyu じゅ zyo じょ
cha ちゃ chu ちゅ cho ちょ tya ちゃ tyu ちゅ tyo ちょ
nya にゃ nyu にゅ nyo にょ hya ひゃ hyu ひゅ hyo ひょ
bya びゃ byu びゅ byo びょ pya ぴゃ pyu ぴゅ pyo ぴょ
mya みゃ myu みゅ myo みょ rya りゃ ryu りゅ ryo りょ
shi し chi ち tsu つ fu ふ
ka か ki き ku く ke け ko こ ga が gi ぎ gu ぐ ge げ go ご
sa さ si し su す se せ so そ za ざ zi じ zu ず ze ぜ zo ぞ
ta た ti ち tu つ te て to と da だ di ぢ du づ de で do ど
na な ni に nu ぬ ne ね no の
ha は hi ひ hu ふ he へ ho ほ ba ば bi び bu ぶ be べ bo ぼ pa ぱ pi ぴ pu ぷ pe ぺ po ぽ
ma ま mi み mu む me め mo も ya や yu ゆ yo よ
ra ら ri り ru る re れ ro ろ wa わ wo を
a あ i い u う e え o お
"""
# --- fixed values: dictionary (raw, output, weight, evidence), in order of declaration ---
JAPANESE_TEXT = """
kyou 今日 6.2 japanese-lexeme
kore これ 5.8 japanese-lexeme
nihongo 日本語 6.2 japanese-lexeme
watashi 私 6.0 japanese-lexeme
watasi 私 5.9 japanese-romaji-alias
gakusei 学生 6.0 japanese-lexeme
ashita 明日 6.0 japanese-lexeme
asita 明日 5.9 japanese-romaji-alias
ame 雨 5.4 japanese-lexeme
samui 寒い 5.6 japanese-lexeme
benkyou 勉強 6.0 japanese-lexeme
tomodachi 友達 6.0 japanese-lexeme
tomodati 友達 5.9 japanese-romaji-alias
kaisha 会社 5.9 japanese-lexeme
kaisya 会社 5.8 japanese-romaji-alias
anime アニメ 5.4 japanese-lexeme
sushi すし 5.4 japanese-lexeme
susi すし 5.3 japanese-romaji-alias
tomato トマト 5.2 japanese-lexeme
miru みる 5.3 japanese-lexeme
tsukau 使う 5.5 japanese-lexeme
tukau 使う 5.4 japanese-romaji-alias
okuru 送る 5.5 japanese-lexeme
tateru たてる 5.4 japanese-lexeme
tateta たてた 5.4 japanese-lexeme
kakunin 確認 5.8 japanese-lexeme
seido 精度 6.0 japanese-lexeme
sugoku すごく 5.8 japanese-lexeme
ii いい 5.3 japanese-lexeme
kanji 感じ 5.9 japanese-lexeme
kannzi 感じ 5.8 japanese-romaji-alias
natta なった 5.8 japanese-verb
konna こんな 5.7 japanese-lexeme
konnna こんな 5.6 japanese-romaji-alias
kamo かも 5.4 japanese-auxiliary
gamenn 画面 5.9 japanese-romaji-alias
gamen 画面 5.8 japanese-lexeme
menndou 面倒 5.7 japanese-romaji-alias
mendou 面倒 5.8 japanese-lexeme
datta だった 5.6 japanese-auxiliary
kou こう 5.3 japanese-lexeme
motikosu 持ち越す 5.6 japanese-romaji-alias
noyatsu のやつ 5.8 japanese-phrase
noyatu のやつ 5.7 japanese-romaji-alias
noyatsudayo のやつだよ 6.3 japanese-phrase
noyatudayo のやつだよ 6.2 japanese-romaji-alias
nado など 5.3 japanese-lexeme
desu です 5.5 japanese-auxiliary
dayo だよ 5.3 japanese-auxiliary
ima 今 5.6 japanese-lexeme
ikimasu 行きます 5.7 japanese-verb
taberu 食べる 5.5 japanese-verb
asobu 遊ぶ 5.5 japanese-verb
simasita しました 6.5 japanese-verb-suffix
simashita しました 6.5 japanese-verb-suffix
shimasita しました 6.5 japanese-verb-suffix
shimashita しました 6.5 japanese-verb-suffix
simasu します 6.1 japanese-verb-suffix
shimasu します 6.1 japanese-verb-suffix
suru する 6.1 japanese-verb-suffix
sita した 5.9 japanese-verb-suffix
shita した 5.9 japanese-verb-suffix
site して 5.8 japanese-verb-suffix
shite して 5.8 japanese-verb-suffix
shitai したい 5.9 japanese-verb-suffix
sitai したい 5.8 japanese-romaji-alias
sareta された 6.0 japanese-verb-suffix
kunakatta くなかった 5.8 japanese-verb-suffix
sityatta しちゃった 6.1 japanese-romaji-alias
shichatta しちゃった 6.1 japanese-verb-suffix
ha は 5.7 japanese-particle
wa は 5.3 japanese-particle
ga が 5.5 japanese-particle
wo を 5.7 japanese-particle
o を 4.5 japanese-particle
ni に 5.5 japanese-particle
de で 5.5 japanese-particle
to と 5.3 japanese-particle
mo も 5.3 japanese-particle
he へ 5.0 japanese-particle
no の 5.5 japanese-particle
kara から 5.4 japanese-particle
made まで 5.4 japanese-particle
yori より 5.4 japanese-particle
yo よ 5.1 japanese-particle
"""
ENGLISH_TEXT = """
commit 6.8 issue 6.6 reflect 6.5 invite 6.4 github 7.0 linux 6.7 kernel 6.6 build 6.4
network 6.5 server 6.4 cache 6.3 deploy 6.4 debug 6.4 google 6.8 push 6.3 pull 6.2
merge 6.4 method 6.5 branch 6.4 repo 5.9 code 6.0 test 6.1 api 5.8 bug 5.7 fix 5.7
windows 6.7 ubuntu 6.7 the 5.9 then 6.0 and 5.8 or 5.2 for 5.6 but 5.5 with 5.8
from 5.8 not 5.7 yes 5.5 can 5.6 this 5.8 that 5.8
"""
# --- fixed values: further words of the language profiles ---
JAPANESE_SEEDS = """
hennkan hennkann kannsite mondai tyotto kotoba bunnkatu dekitenai ninnsiki bunmyaku koreha soreha
dousuru yappari tokoro kangaeru kanousei wakaranai tadasii tukau iretemo nasasou dayone demo nanoga
""".split()
ENGLISH_SEEDS = """
node js jsx ts tsx json html css javascript typescript python rust class string method function object
client server network debug issue commit merge branch github linux kernel cache build deploy window
button input output token
""".split()
# --- fixed values: words, endings, particles and contexts of the out-of-vocabulary study ---
OOV_WORDS = """
knowledge strategy performance schedule feedback actually probably basically weekend meeting project
deadline release update review document customer feature requirement database security backup laptop
keyboard monitor printer wireless calendar holiday airport hospital restaurant library teacher weather
morning evening already quickly slowly carefully suddenly yesterday together important difficult
possible available necessary beautiful wonderful terrible awesome amazing
""".split()
PHONETIC_WORDS = "kuru iku matsu aruku hanasu yomu kaku miseru akeru shimeru oyogu hashiru tsukuru nomu kiku utau odoru warau naku".split()
#: Further words that may not train the English model, and words whose scores the study shows.
STUDY_STOP = "japanese tokyo ime node monitor customer".split()
STUDY_PROBES = "japanese tokyo ime node monitor customer strategy".split()
ENDINGS = ("ology", "tion", "sion", "ment", "ness", "able", "ible", "ese")
STUDY_PARTICLES = "ha ga wo ni de to mo no yo".split()
STUDY_PREFIXES = "kyouha korega watashino imanode".split()
GLUE = "ha ga no ni de to mo".split()


def _pairs(text: str) -> list[tuple[str, str]]:
    x = text.split()
    return list(zip(x[::2], x[1::2], strict=True))


KANA: dict[str, str] = dict(_pairs(KANA_TEXT))
#: What may still become a key, longest first.
PREFIXES: list[str] = sorted({k[:n] for k in KANA for n in range(1, len(k))} | {"n"}, key=lambda p: (-len(p), p))


@dataclass(frozen=True)
class Entry:
    """A dictionary entry; ord is its place by length, weight and declaration."""

    raw: str
    output: str
    language: str
    weight: float
    evidence: str
    ord: int


def _entries() -> list[Entry]:
    rows = []
    for line in JAPANESE_TEXT.strip().splitlines():
        raw, output, weight, kind = line.split()
        rows.append((raw, output, "Japanese", float(weight), kind))
    rows += [(raw, raw, "English", float(weight), "english-lexeme") for raw, weight in _pairs(ENGLISH_TEXT)]
    rows.sort(key=lambda r: (-len(r[0]), -r[3]))
    return [Entry(*r, i) for i, r in enumerate(rows)]


ENTRIES: list[Entry] = _entries()
#: The Japanese entries in the order in which they are declared.
DECLARED: list[str] = list(dict.fromkeys(line.split()[0] for line in JAPANESE_TEXT.strip().splitlines()))


@dataclass(frozen=True)
class LatticeParameters:
    """Tuning of the evidence lattice."""

    beam: int = 16
    phonetic_span: int = 24
    latin_side: int = 12
    consensus_paths: int = 8
    score_window: float = 4.0
    lookahead: int = 3
    stable_frames: int = 2
    switch_penalty: float = 0.30

"""Variant spellings of names: merge-and-rematch resolution.

A spelling is read as an organisation (a place and canonical kind words), a name in Han characters (spaces,
old forms, confusable characters and titles undone) or a person (two or more name parts and initials). Persons are
blocked on the part that goes with the fewest other parts, the surname in whatever order it was typed; a spelling
whose surname cannot be told enters two blocks, and rare variants of a block key one typing error away join its
block. In a block, matched records merge to profiles that unite spellings, given names and initials; a merged
profile is matched again, as an initial that fitted two people may fit only one of the richer profiles. Profiles
that prove to hold the same spelling in two blocks unite and enter all blocks of their spellings again, until
nothing merges any more.

A block receives its distinct readings only, however many spellings have them, and finds the partners of a profile
by an index of given names, so its work grows with the number of matches and not with its square.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut, lookup, spread

#: A name part with so few partners may be a misspelt given name, so it opens a block too.
FEW_PARTNERS = 3
#: How much commoner a key is than one a slip away, if either has fewer than five letters, to be the right form of it.
SHORT_TIMES = 5
#: A given name borne by so small a share of the people who bear one a slip away is a slip of that.
SLIP_SHARE = 0.1

# What stands for an unknown author.
PLACEHOLDERS = frozenset(
    "|anon|anonymous|anonym|anonyme|anonimo|unknown|unbekannt|inconnu|desconocido|desconhecido|various|various hands|various authors|several hands|sn|nn|na|none|null|et al|not known|author unknown|"
    "不詳|著者不詳|作者不詳|未詳|無名|無名氏|佚名|不明|作者不明|無記名|匿名|匿名氏|諸家|неизвестен|неизвестный|аноним|अज्ञात".split("|")
)
# Titles and notes around a name.
TITLES = frozenset("dr prof professor mr mrs ms miss sir rev hon capt col gen frau herr hr m mme mlle sr sra don dona fr lady lord".split())
# Words of organisations' names, abbreviated by their beginnings.
ORG_WORDS = (
    "society association commission institute archive archives department works museum library committee council university college academy office bureau board company guild club "
    "historical antiquarian record records municipal public agricultural county royal national state literary geographical philosophical statistical natural history"
).split()
ORG_KINDS = frozenset("society association commission institute archive archives department works museum library committee council university college academy office bureau board company guild club".split())
ORG_ABBREVIATIONS = {"dept": "department", "comm": "commission", "assn": "association", "soc": "society", "pub": "public", "rec": "record", "arch": "archive", "inst": "institute", "mun": "municipal", "lib": "library", "univ": "university", "natl": "national"}
_SMALL = frozenset("the of for and de du des la le der die das von".split())
# Short forms of given names.
NICKNAMES = {
    "alexander": "sandy alec alex alick sasha xander", "augustin": "gus austin gustl augie", "augustus": "gus", "dorothea": "dolly dot dora thea dorothy dottie", "dorothy": "dolly dot dora", "edmund": "ned ted ed eddie teddy",
    "edward": "ned ted ed eddie teddy", "elizabeth": "betsy bess betty liz lizzie eliza elsie beth libby lisbeth", "frederick": "fred fritz freddy freddie fredric", "gertrude": "trudy gertie trude gert", "helene": "nell lena nellie ellen leni helen",
    "eleanor": "nell nellie nora ellen", "henrietta": "hettie hetty etta harriet netta henny", "henry": "harry hal hank", "ignaz": "naz iggy natz nazl", "isabella": "bella bell izzy isa tibby ella", "jerome": "jem jerry gerry", "james": "jem jim jimmy jamie",
    "jeremiah": "jem jerry", "josephine": "josie jo fifi posy pepi", "joseph": "joe jo sepp", "katherine": "kate kitty kit kathy katie kay", "leopold": "leo poldi poldl", "margaret": "peggy meg maggie daisy greta madge maisie peg meggie",
    "mathaus": "matz matt mattes thes hias", "matthew": "matt", "nathaniel": "nat nate nathan", "octavian": "tavy tavi octy", "philippa": "pippa phil pip", "quentin": "quin quint quen", "richard": "dick rick ricky dickon", "robert": "bob rob bobby robin bert dob",
    "sørine": "rina sofie søs sina", "theodore": "ted theo teddy dory", "ursula": "ulla ursel sula uschi", "valentin": "val valtin velten", "wilhelmina": "minna mina willa billie helma wilma", "william": "bill will billy willy willie liam",
    "zacharias": "zach zack zacky", "charles": "charlie chuck", "thomas": "tom tommy", "john": "jack johnny", "mary": "polly molly mamie", "martha": "patty", "sarah": "sally sadie", "anne": "nan nancy annie", "francis": "frank", "frances": "fanny", "antoine": "toni", "antonio": "toni tonio",
    "johannes": "hans jan", "friedrich": "fritz", "wilhelm": "willi", "heinrich": "heinz", "francisco": "paco pancho", "jose": "pepe", "ekaterina": "katya", "alexandra": "sasha", "dmitri": "mitya", "ivan": "vanya", "nikolai": "kolya", "maria": "masha mitzi",
}
# Old and new forms of Han characters in names.
OLD_FORMS = str.maketrans(
    "櫻澤邊邉瀧實廣濱齋齊斎嶋嶌峯國學惠壽靜德萬藏豐榮眞髙﨑龍條鹽鐵關圓圖櫂渡邨畑淺黑曾會單嚴彌與團應懷戶拔搖擴敍敕晉曆來樂樣橫檢歐歷殘氣沒淨濟營爲獨當發盡眾祕禪禮稻穗總綠緣縣聲臺與蘆虛蟲裝覺讓證譽贊轉辭遙鄕醫釀錄鍊隆隨隱雙雜靈顯驅驛體鷄麥黨齡齒龜兒亞佛價傳儀劍勞勳勵區參嚙壞壯壹寢對專將尙屆屬巢帶廢彈從恆悅惡戰擇擊據擧攝敎數晝曉條枢槪樓權歡步殼每浪淸溪滿漢潛澁瀨燈燒燕犧狹獸玆瓣畫疊癡盜硏礎福竊粹絲經繪繼續纖羣舊舍莊萩藝藥蘭號蠶衞裏變豫賣賴贈踐輕遞遲邦釋鎭鑄闊陷險雞靑靜顏飮餘駐騷鬪鶴鷗鹿",
    "桜沢辺辺滝実広浜斉斉斉島島峰国学恵寿静徳万蔵豊栄真高崎竜条塩鉄関円図櫂渡村畑浅黒曽会単厳弥与団応懐戸抜揺拡叙勅晋暦来楽様横検欧歴残気没浄済営為独当発尽衆秘禅礼稲穂総緑縁県声台与芦虚虫装覚譲証誉賛転辞遥郷医醸録錬隆随隠双雑霊顕駆駅体鶏麦党齢歯亀児亜仏価伝儀剣労勲励区参噛壊壮壱寝対専将尚届属巣帯廃弾従恒悦悪戦択撃拠挙摂教数昼暁条枢概楼権歓歩殻毎浪清渓満漢潜渋瀬灯焼燕犠狭獣茲弁画畳痴盗研礎福窃粋糸経絵継続繊群旧舎荘萩芸薬蘭号蚕衛裏変予売頼贈践軽逓遅邦釈鎮鋳闊陥険鶏青静顔飲余駐騒闘鶴鴎鹿",
)
# Characters of given names that are taken for one another when they are typed by their sound.
OLD_FORMS |= str.maketrans("朗籐", "郎藤")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_HAN_TAIL = regex.compile(r"(?:著者|著|編著|編|氏|先生|撰|記|輯|校|訳|譯|君|殿|様|女史)$")
_NOTE = regex.compile(r"\([^)]*\)|\[[^\]]*\]|（[^）]*）|［[^］]*］")
_PART = regex.compile(r"[\p{L}\p{M}'’\-]+\.?")


def fold(s: str) -> str:
    """Lower case without marks."""
    t = unicodedata.normalize("NFKD", s.lower()).replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("œ", "oe").replace("ł", "l").replace("đ", "d").replace("ð", "d").replace("þ", "th")
    return regex.sub(r"\p{M}", "", t).replace("’", "'")


#: Short form -> full name -> how far down that name's list it stands.
_FULL_OF: dict[str, dict[str, int]] = {}
for _full, _short in NICKNAMES.items():
    for _i, _n in enumerate(_short.split()):
        _FULL_OF.setdefault(fold(_n), {})[fold(_full)] = _i


def one_slip(a: str, b: str) -> bool:
    """At most one insertion, deletion, replacement or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return short[i:] == long[i + 1 :]


def parse(name: str) -> tuple[str, str, list[str], list[str], int]:
    """(kind, key, parts, initials, surname): kind is none, han, org or person.

    ``key`` identifies a han name; of an organisation it is the place, and ``parts`` its sorted kind words. Of
    a person ``parts`` are the folded parts longer than an initial and ``surname`` the index of the surname if
    the form shows it, else -1.
    """
    none = ("none", "", [], [], -1)
    t = unicodedata.normalize("NFKC", name) if "　" not in name else "　".join(unicodedata.normalize("NFKC", p) for p in name.split("　"))
    bare = regex.sub(r"[^\p{L}\p{M}]+", " ", fold(t)).strip()
    if bare in PLACEHOLDERS or bare.replace(" ", "") in PLACEHOLDERS:
        return none
    t = _NOTE.sub(" ", t).strip()
    if _HAN.search(t):
        key = regex.sub(r"[^\p{L}\p{M}々]", "", t)
        cut_ = _HAN_TAIL.sub("", key)
        key = (cut_ if len(cut_) >= 2 else key).translate(OLD_FORMS)
        return ("han", key, [], [], -1) if key not in PLACEHOLDERS and len(key) > 1 else none
    words = [fold(w).rstrip(".") for w in _PART.findall(t)]
    words = [w.removesuffix("'s") for w in words if w]
    kinds = [(w, org_word(w)) for w in words]
    if any(k in ORG_KINDS for _, k in kinds):
        place = " ".join(w for w, k in kinds if not k and w not in _SMALL)
        return ("org", place, sorted({k.rstrip("s") if k not in ("works",) else k for _, k in kinds if k}), [], -1)
    comma = regex.split(r"[,，]", t, maxsplit=1) if regex.search(r"[,，]", t) else None
    sides = comma or (t.split("　", 1) if "　" in t.strip() else None)
    parts, initials, surname = [], [], -1
    for k, side in enumerate(sides or [t]):
        for w in _PART.findall(regex.sub(r"(?<=\p{L})\.(?=\p{L})", ". ", side)):
            f = fold(w).strip(".'-")
            if not f or (len(f) > 1 and f in TITLES and len(words) > 2):
                continue
            if len(f) == 1:
                initials.append(f)
            else:
                if sides and k == 0:
                    surname = len(parts)
                parts.append(f)
    if not parts or (len(parts) == 1 and not initials):
        return ("han", "=" + parts[0], [], [], -1) if parts else none
    if len(parts) == 1:
        surname = 0
    return ("person", "", parts, initials, surname)


def org_word(w: str) -> str | None:
    """The canonical word that ``w`` is, abbreviates or misspells; None for a place."""
    if w in ORG_WORDS:
        return w
    if w in ORG_ABBREVIATIONS:
        return ORG_ABBREVIATIONS[w]
    if len(w) >= 3:
        full = [x for x in ORG_WORDS if x.startswith(w) and len(w) < len(x)]
        if full and len(w) <= 5:
            return full[0]
    if len(w) >= 5:
        for x in ORG_WORDS:
            if len(x) >= 5 and one_slip(w, x):
                return x
    return None


@dataclass
class Profile:
    """What is known of one person: spellings, given names and initials."""

    members: list[int]
    given: set[str]
    first: set[str]
    middle: set[str] = field(default_factory=set)
    slip: bool = False


def full_names(short: str) -> set[str]:
    return set(_FULL_OF.get(short, ()))


def full_given(name: str, block: set[str]) -> str:
    """The full name of the block that a short form stands for: the one whose list has it first; else itself."""
    rank = sorted((i, f) for f, i in _FULL_OF.get(name, {}).items() if f in block)
    return rank[0][1] if rank and (len(rank) == 1 or rank[0][0] < rank[1][0]) else name


def slip_of(a: str, b: str, common: dict[str, int]) -> bool:
    """Whether one of two given names a slip apart is a slip of the other, not a name of its own."""
    few, many = sorted((common.get(a, 0), common.get(b, 0)))
    return few <= FEW_PARTNERS or few < SLIP_SHARE * many


def related_names(names: set[str], common: dict[str, int]) -> tuple[dict[str, set[str]], dict[str, set[str]]]:
    """For each given name those that are the same: (by short forms alone, by beginnings, ends and slips too).

    Partners are looked up: a short form's full names, the beginnings and ends of a name among the short ones, and
    for slips the names that are left when one character is dropped.
    """
    close = {a: {a} for a in names}
    for a in names:
        for b in full_names(a) & names:
            close[a].add(b)
            close[b].add(a)
    wide = {a: set(v) for a, v in close.items()}
    rests: dict[str, list[str]] = {}
    for f in sorted(names):
        for k in (3, 4, 5):
            if len(f) >= k + 2:
                for s in {f[:k], f[-k:]} & names:
                    wide[f].add(s)
                    wide[s].add(f)
        if len(f) >= 4:
            for r in {f, *(f[:i] + f[i + 1 :] for i in range(len(f)))}:
                rests.setdefault(r, []).append(f)
    for own in rests.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if b not in wide[a] and one_slip(a, b) and slip_of(a, b, common):
                    wide[a].add(b)
                    wide[b].add(a)
    return close, wide


class Block:
    """The profiles of a block and indexes of their given names and initials."""

    def __init__(self, profiles: list[Profile], common: dict[str, int]) -> None:
        self.close, self.wide = related_names({g for p in profiles for g in p.given}, common)
        self.live: dict[int, Profile] = {}
        self.by_given: dict[str, set[int]] = {}
        self.by_first: dict[str, set[int]] = {}
        for i, p in enumerate(profiles):
            self.live[i] = p
            self.enter(i)

    def enter(self, i: int) -> None:
        for g in self.live[i].given:
            self.by_given.setdefault(g, set()).add(i)
        for c in self.live[i].first:
            self.by_first.setdefault(c, set()).add(i)

    def leave(self, i: int) -> None:
        for g in self.live[i].given:
            self.by_given[g].discard(i)
        for c in self.live[i].first:
            self.by_first[c].discard(i)
        del self.live[i]

    @staticmethod
    def clash(p: Profile, q: Profile) -> bool:
        return bool(p.middle and q.middle and not p.middle & q.middle)

    def strong(self, i: int) -> set[int]:
        """Profiles that fit by given names."""
        p = self.live[i]
        near = {k for g in p.given for h in self.close[g] for k in self.by_given[h]}
        # one slip is enough: with another surname the given names must agree
        far = set() if p.slip else {k for g in p.given for h in self.wide[g] for k in self.by_given[h] if not self.live[k].slip}
        return {k for k in near | far if k != i and not self.clash(p, self.live[k])}

    def apart(self, p: Profile, q: Profile) -> bool:
        """Whether the two are different people for sure."""
        return self.clash(p, q) or bool(p.given and q.given) and not any(self.wide[g] & q.given for g in p.given)

    def merge(self, i: int, j: int) -> None:
        p, q = self.live[i], self.live[j]
        self.leave(j)
        p.members += q.members
        p.given |= q.given
        p.first |= q.first
        p.middle |= q.middle
        p.slip &= q.slip
        self.enter(i)

    def by_names(self, todo: list[int]) -> bool:
        """Merge what given names unite, beginning with the profiles ``todo``; whether any did."""
        rank = lambda i: (not self.live[i].given, not self.live[i].middle, -len(self.live[i].members), i)
        heap = [rank(i) for i in todo]
        heapq.heapify(heap)
        changed = False
        while heap:
            i = heapq.heappop(heap)[-1]
            if i not in self.live or not self.live[i].given:
                continue
            mine = self.strong(i)
            for j in sorted(mine):
                p, q = self.live[i], self.live[j]
                # a name that two different people could bear is left alone until they turn out to be one
                if any(self.apart(q, self.live[x]) for x in mine - {j}) or any(self.apart(p, self.live[x]) for x in self.strong(j) - {i}):
                    continue
                around = mine | self.strong(j)
                self.merge(i, j)
                changed = True
                for x in {i, *around, *self.strong(i)} & self.live.keys():
                    heapq.heappush(heap, rank(x))
                break
        return changed

    def by_initials(self) -> bool:
        """Merge the profiles without a given name into the only one that they fit; whether any did."""
        changed = False
        for j in [i for i, p in self.live.items() if not p.given]:
            if j not in self.live:
                continue
            q = self.live[j]
            able = {k for c in q.first for k in self.by_first[c] if k != j and not self.clash(q, self.live[k])}
            exact = [k for k in able if q.middle and self.live[k].middle & q.middle]
            named = [k for k in able if self.live[k].given]
            pick = exact if len(exact) == 1 else list(able) if len(able) == 1 else named if len(named) == 1 else []
            if pick:
                self.merge(pick[0], j)
                self.by_names([pick[0], *self.strong(pick[0])])
                changed = True
        return changed


def resolve_profiles(profiles: list[Profile], common: dict[str, int]) -> list[Profile]:
    """The profiles of a block, merged as far as they match. ``common``: how many surnames each given name goes with."""
    by: dict[tuple, Profile] = {}
    for p in profiles:  # equal ones first
        k = (frozenset(p.given), frozenset(p.first), frozenset(p.middle), p.slip)
        if k in by:
            by[k].members += p.members
        else:
            by[k] = p
    block = Block(list(by.values()), common)
    block.by_names(list(block.live))
    while block.by_initials():
        pass
    return list(block.live.values())


def profiles_of(records: list[tuple[list[str], list[str], str, str]]) -> list[Profile]:
    """A profile for each (given names, initials, surname as typed, block's surname) of a block."""
    block = {g for given, _, _, _ in records for g in given[:1]}
    out = []
    for i, (given, initials, typed, key) in enumerate(records):
        g = {full_given(given[0], block)} if given else set()
        first = {x[0] for x in (*g, *given[:1], *(f for s in g for f in full_names(s)))} or set(initials[:1])
        middle = {x[0] for x in given[1:]} | set(initials if given else initials[1:])
        out.append(Profile([i], g, first, middle, typed != key))
    return out


def resolve_block(records: list[tuple[list[str], list[str], str, str]], common: dict[str, int]) -> list[int]:
    """Cluster number of each record of a block, as :func:`profiles_of` takes them."""
    out = [0] * len(records)
    for c, p in enumerate(resolve_profiles(profiles_of(records), common)):
        for i in p.members:
            out[i] = c
    return out


# ---- Spark side

_PARSED = "name string, kind string, key string, parts array<string>, initials array<string>, surname int"


def _parse_all(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, *parse(n)) for n in pdf.name]
            yield pd.DataFrame(rows, columns=["name", "kind", "key", "parts", "initials", "surname"])

    return names.mapInPandas(run, _PARSED)


def block_keys(keys: DataFrame, col: str = "key", weight: str = "n") -> DataFrame:
    """(key, main): each key, and the key its slips lead to (or itself).

    A key goes to the most common of all commoner keys at most one slip away, that one to its own, and so on to
    the end. Where one of the two has fewer than five letters, the other must be ``SHORT_TIMES`` as common, as short names
    a letter apart are often different ones. Keys meet on what is left when one character is dropped: a rest has no more keys than an alphabet has
    letters for each place, so its pairs are few whatever the size of the table.
    """
    k = keys.select(F.col(col).alias("key"), F.col(weight).alias("n"))
    drops = k.where(F.length("key") >= 3).select(
        "key", "n", F.explode(F.array_distinct(F.concat(F.array("key"), F.expr("transform(sequence(1, length(key)), i -> concat(substring(key, 1, i - 1), substring(key, i + 1)))")))).alias("rest")
    )
    drops = cut(drops)
    other = drops.select(F.col("rest").alias("_rest"), F.col("key").alias("k"), F.col("n").alias("m"))
    cand = drops.join(other, F.col("rest") == F.col("_rest")).where("k <> key and (m > n or (m = n and k > key))").where((F.least(F.length("key"), F.length("k")) >= 5) | (F.col("m") >= SHORT_TIMES * F.col("n"))).select("key", F.col("m").alias("n"), "k").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[one_slip(a, b) for a, b in zip(pdf.key, pdf.k)]]

    best = cand.mapInPandas(run, "key string, n long, k string").groupBy("key").agg(F.max(F.struct("n", "k")).alias("m")).select("key", F.col("m.k").alias("main"))
    best = cut(best)
    # a variant of a variant: links lead to ever commoner keys, and each round doubles their length
    moved = True
    while moved:
        up = best.select(F.col("key").alias("_k"), F.col("main").alias("_m"))
        best = cut(best.join(up, F.col("main") == F.col("_k"), "left").select("key", F.coalesce("_m", "main").alias("main"), F.col("_m").isNotNull().alias("moved")))
        moved = not best.where("moved").isEmpty()
        best = best.drop("moved")
    return k.select("key").distinct().join(best, "key", "left").select("key", F.coalesce("main", "key").alias("main"))


def resolve_names(names: DataFrame, col: str = "name") -> DataFrame:
    """(name, identity): every spelling that names someone, with the key of its identity.

    Spellings are compared as stored, surrounding spaces (U+0020) apart. Null, empty and placeholder spellings
    are left out, repeated ones count once, an empty table gives an empty result.
    """
    one = cut(_parse_all(names.select(F.trim(F.col(col)).alias("name")).where("name is not null and name <> ''").distinct()).where("kind <> 'none'"))
    han = one.where("kind = 'han'").select("name", F.concat(F.lit("h:"), "key").alias("identity"))

    orgs = one.where("kind = 'org'")
    places = block_keys(orgs.groupBy("key").agg(F.count("*").alias("n"))).select(F.col("key").alias("_k"), "main")
    org = lookup(orgs, "key", places, "_k").select("name", F.concat_ws(":", F.lit("o"), F.coalesce("main", "key"), F.array_join("parts", " ")).alias("identity"))

    people = one.where("kind = 'person'").select("name", "parts", "initials", "surname")
    each = people.select("surname", "parts", F.posexplode("parts").alias("pos", "part"))
    as_surname = F.when(F.col("surname") >= 0, F.col("pos") == F.col("surname")).otherwise(F.col("pos") == F.size("parts") - 1)
    other = F.when(F.size("parts") > 1, F.element_at("parts", F.when(F.col("pos") == 0, F.size("parts")).otherwise(F.lit(1))))
    # of each part: with how many others it goes, and how often it stands where surnames stand
    partners = each.groupBy("part", other.alias("other")).agg(F.sum(as_surname.cast("int")).alias("s"), F.count("*").alias("n")).groupBy("part")
    partners = cut(partners.agg(F.count("other").alias("d"), ((F.sum("s") + 1) / (F.sum("n") + 2)).alias("share")))
    ends = cut(people.withColumn("a", F.element_at("parts", 1)).withColumn("z", F.element_at("parts", -1)))
    for end in ("a", "z"):
        ends = cut(lookup(ends, end, partners.select(F.col("part").alias(f"_{end}"), F.col("d").alias(f"d{end}"), F.col("share").alias(f"s{end}")), f"_{end}"))
    shown = F.col("surname") >= 0
    last = (F.col("sz") > F.col("sa")) | ((F.col("sz") == F.col("sa")) & (F.col("dz") <= F.col("da")))
    main = F.when(shown, F.expr("element_at(parts, surname + 1)")).otherwise(F.when(last, F.col("z")).otherwise(F.col("a")))
    also = F.when(~shown & (F.size("parts") > 1) & (F.greatest("da", "dz") <= FEW_PARTNERS), F.when(last, F.col("a")).otherwise(F.col("z")))
    placed = cut(ends.select("name", "parts", "initials", shown.alias("shown"), F.explode(F.array_compact(F.array(main, also))).alias("typed")))
    mains = block_keys(placed.groupBy("typed").agg(F.count("*").alias("n")), "typed").select(F.col("key").alias("_k"), F.col("main").alias("block"))
    placed = lookup(placed, "typed", mains, "_k").select("name", "parts", "initials", "shown", "typed", "block")
    # given names that many bear; the first part apart from the surname is looked up
    placed = placed.withColumn("given", F.expr("filter(parts, p -> p <> typed)")).withColumn("g0", F.get("given", F.lit(0)))
    known = lookup(cut(placed), "g0", partners.select(F.col("part").alias("_g"), F.col("d").alias("dg")), "_g")
    person = _resolve_people(known).select("name", "identity")
    return cut(han.unionByName(org).unionByName(person))


_CLUSTER = "reading string, cluster string, block string, given array<string>, first array<string>, middle array<string>, slip boolean"


def _resolve_people(placed: DataFrame) -> DataFrame:
    """(name, identity) of spellings placed in blocks: name, given, initials, shown, typed, block, g0 and dg, the number
    of surnames that the first given name goes with."""
    reading = F.concat_ws("\x01", "block", "typed", F.array_join("given", " "), F.array_join("initials", " "))
    placed = cut(placed.withColumn("reading", reading))
    # many spellings have one reading, and only that goes to a block
    distinct = placed.groupBy("reading", "block", "typed", "given", "initials").agg(F.min("name").alias("lead"), F.max("g0").alias("g0"), F.max("dg").alias("dg"))

    def first_round(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lead")
        common = {g: int(d) for g, d in zip(pdf.g0, pdf.dg) if isinstance(g, str) and d == d}
        own = profiles_of([(list(g), list(i), t, b) for g, i, t, b in zip(pdf.given, pdf.initials, pdf.typed, pdf.block)])
        own = [(list(p.given), list(p.first), list(p.middle), p.slip) for p in own]
        reading, lead, block = pdf.reading.tolist(), pdf["lead"].tolist(), pdf.block.iloc[0]
        merged = resolve_profiles([Profile([i], set(g), set(f), set(m), s) for i, (g, f, m, s) in enumerate(own)], common)
        rows = [(reading[i], f"p:{block}:{lead[min(p.members)]}", block, *own[i]) for p in merged for i in p.members]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _CLUSTER.split(", ")])

    found = cut(spread(distinct, "block").groupBy("block").applyInPandas(first_round, _CLUSTER))
    at = cut(placed.join(found.select(F.col("reading").alias("_r"), "cluster"), F.col("reading") == F.col("_r")).groupBy("name", "cluster").agg(F.max("shown").alias("shown")))
    size = at.groupBy(F.col("cluster").alias("_c")).agg(F.count("*").alias("n"), F.max("shown").alias("seen"))
    at = cut(lookup(at, "cluster", size, "_c").drop("_c"))
    # a spelling that has company in two blocks unites the two profiles, unless both show another surname
    both = at.groupBy("name").agg(F.collect_list(F.struct("cluster", "n", "seen")).alias("c")).where(F.size("c") > 1)
    links = cut(both.where("c[0].n > 1 and c[1].n > 1 and not (c[0].seen and c[1].seen)").select(F.col("c")[0]["cluster"].alias("a"), F.col("c")[1]["cluster"].alias("b")).distinct())
    if not links.isEmpty():
        common = placed.where("g0 is not null").groupBy("block").agg(F.map_from_entries(F.collect_set(F.struct("g0", F.coalesce("dg", F.lit(0)).alias("d")))).alias("common"))
        into = _rematch(found, links, cut(common))
        at = cut(at.join(into.select(F.col("cluster").alias("_c"), "top"), F.col("cluster") == F.col("_c"), "left").select("name", F.coalesce("top", "cluster").alias("cluster")))
        at = at.distinct()
        n = at.groupBy(F.col("cluster").alias("_c")).agg(F.count("*").alias("n"))
        at = lookup(cut(at), "cluster", n, "_c")
    # otherwise it goes where it has more company
    return at.groupBy("name").agg(F.max(F.struct("n", "cluster")).alias("m")).select("name", F.col("m.cluster").alias("identity"))


def _rematch(found: DataFrame, links: DataFrame, common: DataFrame) -> DataFrame:
    """(cluster, top): the clusters that links unite, and what they merge with when they enter their blocks again."""
    sets = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    parts = found.groupBy("cluster", "block").agg(sets("given"), sets("first"), sets("middle"), F.min("slip").alias("slip"))
    into = cut(components(links).select(F.col("node").alias("cluster"), F.col("root").alias("top")))
    parts = cut(parts)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        known = {k: int(v) for k, v in (pdf.common.iloc[0] or {}).items()} if pdf.common.iloc[0] is not None else {}
        own = [Profile([i], set(g), set(f), set(m), bool(s)) for i, (g, f, m, s) in enumerate(zip(pdf.given, pdf["first"], pdf.middle, pdf.slip))]
        names = pdf.cluster.tolist()
        rows = [(names[i], names[min(p.members)]) for p in resolve_profiles(own, known) for i in p.members if i != min(p.members)]
        return pd.DataFrame(rows, columns=["a", "b"])

    while True:
        top = F.coalesce("top", "cluster")
        now = cut(parts.join(into.withColumnRenamed("cluster", "_c"), F.col("cluster") == F.col("_c"), "left").withColumn("cluster", top).drop("_c", "top"))
        # richer profiles enter all blocks of their spellings; what was read with another surname there has that for a
        # given name here
        blocks = now.select(F.col("cluster").alias("_c"), F.col("block").alias("_to")).distinct()
        fresh = now.join(into.select(F.col("top").alias("_t")).distinct(), F.col("cluster") == F.col("_t"), "left_semi").select(F.col("block").alias("_b")).distinct()
        here = F.col("block") == F.col("_to")
        enter = now.join(blocks, F.col("cluster") == F.col("_c")).select(
            "cluster", F.col("_to").alias("block"), F.when(here, F.col("given")).otherwise(F.array("block")).alias("given"),
            F.when(here, F.col("first")).otherwise(F.array(F.substring("block", 1, 1))).alias("first"), "middle", F.when(here, F.col("slip")).alias("slip"),
        )
        enter = enter.groupBy("cluster", "block").agg(sets("given"), sets("first"), sets("middle"), F.coalesce(F.min("slip"), F.lit(False)).alias("slip"))
        enter = enter.join(fresh, F.col("block") == F.col("_b"), "left_semi").join(common.withColumnRenamed("block", "_k"), F.col("block") == F.col("_k"), "left").drop("_k")
        more = cut(spread(enter, "block").groupBy("block").applyInPandas(again, "a string, b string"))
        if more.isEmpty():
            return into
        all_ = into.select(F.col("cluster").alias("a"), F.col("top").alias("b")).unionByName(more)
        into = cut(components(all_).select(F.col("node").alias("cluster"), F.col("root").alias("top")))


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected components of links (a, b); root is the smallest node.

    Each round takes the smallest label among a node's neighbours and then that label's own, so the number of
    rounds grows with the logarithm of a component's length.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    while True:
        label = cut(label)
        of = label.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        near = edges.join(of, F.col("b") == F.col("_n")).groupBy(F.col("a").alias("_a")).agg(F.min("_r").alias("m"))
        low = label.join(near, F.col("node") == F.col("_a")).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        low = cut(low)
        jump = low.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        nxt = cut(low.join(jump, F.col("root") == F.col("_n"), "left").select("node", "was", F.least("root", F.coalesce("_r", "root")).alias("root")))
        if nxt.where("was <> root").isEmpty():
            return nxt.select("node", "root")
        label = nxt.select("node", "root")


def spelling_pairs(resolved: DataFrame) -> DataFrame:
    """All pairs of different spellings of one identity: name_a < name_b."""
    b = resolved.select(F.col("identity").alias("_i"), F.col("name").alias("name_b"))
    return resolved.join(b, (F.col("identity") == F.col("_i")) & (F.col("name") < F.col("name_b"))).select(F.col("name").alias("name_a"), "name_b").distinct()

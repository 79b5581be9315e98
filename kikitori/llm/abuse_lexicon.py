"""Fixed values of the moderation grammar: general vocabulary by lexical symbol, Japanese and English.

``CORE`` words make a sentence a candidate and may be masked; ``CONTEXT`` patterns are read in candidates only. Inflected
forms are built by rule where there are many. Nothing here decides by itself: the clauses of the grammar do.
"""

from __future__ import annotations

# verbs in their te-form that harm a person; followed by "will do" they threaten
_HARM_TE = (
    "殺して ぶっ殺して ぶち殺して 殴って ぶん殴って 殴り殺して ぶちのめして 叩きのめして 刺して 刺し殺して へし折って ぶっ潰して 握り潰して 火をつけて 火を付けて 放火して"
    " 首を絞めて 絞め殺して 切り刻んで 引き裂いて 八つ裂きにして 撃ち殺して 痛めつけて ボコボコにして ぼこぼこにして ボコって 半殺しにして 皆殺しにして 蹴り殺して 地獄を見せて"
    " 後悔させて 呪い殺して 始末して 叩き潰して 息の根を止めて 痛い目に遭わせて 痛い目にあわせて 血祭りにあげて 血祭りに上げて ぶっ飛ばして シメて しばいて"
).split()
# the same for verbs that harm only with a person, a body or a home as their object
_MAY_HARM_TE = "折って 潰して 燃やして 焼いて 消して 埋めて 沈めて 撃って 切って 切り落として 壊して 砕いて 蹴って 引きずり出して 切り裂いて もいで むしって 閉じ込めて".split()
_WILL_DO = "やる やるよ やるぞ やるぜ やるから やろうか やろう やりたい やんよ やっから".split()
_HARM_PLAIN = "へし折る 刺し殺す 絞め殺す 殴り殺す 叩きのめす ぶちのめす 切り刻む 引き裂く 撃ち殺す 痛めつける 叩き潰す 握り潰す 呪い殺す 始末する 殺す ぶっ殺す ぶち殺す 刺す 殴る 燃やす 潰す ぶっ潰す 埋める 沈める しばく ぶん殴る ぶっ飛ばす シメる 焼く 撃つ".split()

# adjectives that run people down, and their superlatives
_BAD = "stupid|dumb|pathetic|worthless|useless|disgusting|ugly|brainless|moronic|idiotic|vile|repulsive|filthy|spineless|despicable|loathsome|hopeless|incompetent|revolting|deranged|braindead".split("|")
_BAD += [a.removesuffix("e") + "est" if not a.endswith("y") else a[:-1] + "iest" for a in ("stupid", "dumb", "ugly", "vile", "filthy", "nasty", "mean", "lazy", "weak", "sick", "fat")]

CORE = {
    "INS": (
        "バカ アホ クズ カス マヌケ ゴミクズ ゴミ野郎 ブタ野郎 クソ野郎 能なし 能無し 役立たず ろくでなし 出来損ない できそこない 間抜け 馬鹿 馬鹿者 馬鹿野郎 バカ野郎 バカヤロー バカもの 阿呆 負け犬 無能"
        " クソガキ 雌豚 人でなし 卑怯者 臆病者 腰抜け 恥知らず 恥さらし クソババア クソジジイ クソ女 クソ男 老害 低能 うすのろ とんま たわけ 負け組 人間のクズ 社会のゴミ 社会のクズ 最低の人間 最低な人間"
        " 最低野郎 くそったれ 下衆 ゲス野郎 下種 ドブネズミ 虫けら 虫ケラ 蛆虫 寄生虫野郎 ダメ人間 駄目人間 クズ人間 屑 人間の屑 カスゴミ 恩知らず 裏切り者 嘘つき野郎 無能野郎 木偶の坊 デクノボウ ぼんくら ボンクラ 馬鹿女 バカ女 バカ男 アホ面 ブサイク 不細工 デブス ウジ虫 犬畜生 キチガイ 気違い アバズレ 売女 ヤリマン ビッチ 変態野郎 根性なし 穀潰し 疫病神 面汚し 薄のろ"
    ).split(),
    "INS_en": (
        "idiot|moron|imbecile|dumbass|dumbfuck|fool|loser|scum|scumbag|asshole|arsehole|bastard|bitch|whore|slut|cunt|dickhead|prick|retard|cretin|halfwit|nitwit|dimwit|dunce|twat|wanker|jackass"
        "|motherfucker|son of a bitch|piece of shit|piece of garbage|piece of trash|piece of crap|piece of filth|stupid pig|stupid cow|fat pig|filthy pig|waste of space|waste of oxygen|waste of skin|worthless scum"
        "|pathetic loser|degenerate|bimbo|swine|maggot|lowlife|scoundrel|simpleton|ignoramus|dirtbag|douchebag|shithead|fuckwit|bonehead|numbskull|psychopath|sociopath|pervert|liar|hypocrite|parasite of a man|traitor|cheat|fraud of a|snob|bully|crybaby|weakling|good for nothing|pathetic excuse|disgrace to"
    ).split("|"),
    "INSW": "ゴミ ブタ 豚 ハゲ ブス デブ ガキ ババア ジジイ ボケ クソ ゲス 変態 底辺 ポンコツ チビ 畜生 外道".split(),
    "INSW_en": "pig|trash|garbage|rat|worm|snake|clown|coward|failure|creep|freak|weirdo|hag|cow|dog|monster|jerk|disgrace|burden|joke|parasite|cockroach|rubbish|shit|skank|slob|brat|leech|tramp|psycho|lunatic|nutcase|wretch|bum|goblin|ogre|toad|slug|sheep|donkey".split("|"),
    "ADJ": "キモい きもい キモすぎ キモイ 気持ち悪い 気色悪い うざい ウザい ウザイ 頭悪い 頭が悪い 頭がおかしい 頭おかしい 醜い 情けない 使えない 薄汚い 気色わるい 目障りな 鬱陶しい うっとうしい 胸くそ悪い 見苦しい 不愉快な 性格が悪い 頭が弱い 頭の弱い ダサい 汚らわしい みっともない 卑しい 脳みそがない 救いようがない 救いようのない".split(),
    "ADJ_en": _BAD,
    "DIE": "死ね 死にやがれ 死んでくれ 死んじまえ 死んでしまえ くたばれ くたばっちまえ 地獄に落ちろ 地獄へ落ちろ 失せろ 消えろ 消え失せろ 自殺しろ 首を吊れ 首吊れ 飛び降りろ 死んだほうがいい 死んだ方がいい 死んだほうがまし 死ねばいい 死ねばいいのに 死ねばよかった 死んだらいい 死んで当然 死んで詫び".split(),
    "DIE_en": "go and die|go die|drop dead|kill yourself|hang yourself|go to hell|burn in hell|rot in hell|die in a fire|jump off a bridge|jump off a cliff|end your life|fuck you|fuck off|piss off|screw you|kys|do us all a favor and die".split("|"),
    "DIS": "口を開くな 黙れ 二度と来るな 黙ってろ うせろ 引っ込んでろ 消え去れ 目障り 顔も見たくない 口を閉じろ".split(),
    "DIS_en": "shut your mouth|get lost|shut up|shut the hell up|shut the fuck up|get out of my sight|never come back".split("|"),
    "DEV": (
        "生きてる価値 生きている価値 生きる価値 生きる資格 生きてる意味 生まれてこなければよかった 生まれてこなきゃよかった 誰も必要としてない 誰も必要としていない 誰もお前なんか 誰からも必要とされ 陰で笑って 吐き気がする 反吐が出る 虫唾が走る"
        " 人前に出るな 二度と見たくない 俺が間違いだった いなくなればいい 消えてしまえばいい 消えればいい 消えてくれ いないほうがまし いない方がまし 存在する価値 存在価値 存在自体が 生きてて恥ずかしく 生きてるだけで迷惑 みんなに嫌われて 誰にも愛され"
    ).split(),
    "DEV_en": [f"{q} {x}" for q in ("nobody", "no one", "no-one") for x in ("would care if you", "would notice if you", "cares about you", "would cry at your funeral", "would miss you", "will miss you", "likes you", "wants", "loves you", "will ever love you", "needs you")]
    + (
        "your existence is|your birth was|you are a mistake|you were a mistake|biggest mistake|waste of a human|everybody hates you|everyone hates you|we all hate you"
        "|you make me sick|makes me sick|make me want to vomit|should never have been born|should not have been born|wish you were never born|world would be better without you|better off without you|you disgust me|hate your guts|waste of everyone|not worth the air"
        "|hope you die|hope you get|hope you suffer|hope you rot|hope you choke|wish you were dead|you are better off dead|do not deserve to live|don't deserve to live|deserve to suffer|deserve to die|sick of your face|too stupid to"
    ).split("|"),
    "THX": [*(a + b for a in _HARM_TE for b in _WILL_DO), *(a + b for a in _HARM_PLAIN for b in ("ぞ", "からな", "ぜ", "からね")), "ぶっ殺す", "ぶち殺す"],
    "THW": [a + b for a in _MAY_HARM_TE for b in _WILL_DO],
    "THY": [*_HARM_PLAIN, "殺します", "殺しに行く", "刺しに行く", "殺しに来", "ぶっ殺します"],
    "THS": "ただじゃおかない ただじゃおかねえ ただではおかない ただじゃ済まさない ただでは済まさない ただじゃすまない ただじゃ済まない ただで済むと思う 生きて帰れると思うな 命はないと思え 命はないぞ 命が惜しければ 夜道に気をつけ 背後に気をつけ 首を洗って待って 無事で済むと思う 痛い目に遭う 痛い目にあう 痛い目を見 明日はないと思え".split(),
    "THP": "覚悟しとけ 覚悟しろ 覚悟しておけ 待ってるからな 骨の一本 家は知って 家を知って 住所は知って 後悔する 逃げられると思う 逃がさない どうなっても知ら 家族がどうなる 命はない 思い知らせて".split(),
    "THV_en": "kill|murder|stab|strangle|choke|slit|gut|hurt|skin|drown|cripple|bash|torture|smash|slaughter|butcher|beat you up|beat the shit out of|beat the crap out of".split("|"),
    "THVW_en": "shoot|beat|punch|break|crush|burn|rip|tear|bury|hunt|poison|slap|snap|destroy|cut|execute|hang|kick|throw|knock|carve|twist|drag|chop".split("|"),
    "PUT_en": "set|make|put|end|give".split("|"),
    "THS_en": (
        "you are dead|you're dead|youre dead|dead meat|you will regret|you'll regret|you will pay for|you'll pay for|watch your back|i know where you live|we know where you live|i will find you|i'll find you|i will end you|i'll end you"
        "|your days are numbered|you will be sorry|you'll be sorry|sleep with one eye open|you will not live to|you won't live to|not leave here alive|never walk again|never see your family|wish you were never|beg for mercy"
    ).split("|"),
    "DEG": (
        "害虫 寄生虫 ゴキブリ 病原菌 ばい菌 バイ菌 人間以下 人間じゃない 人間ではない 人間扱いする必要 人間扱いしなくて 動物以下 けだもの 獣以下 下等 劣等 劣った 劣って 劣る人種 劣る民族 盗人 泥棒ばかり 犯罪者ばかり 犯罪者の集まり 犯罪者予備軍"
        " 血は汚れ 血が汚れ 汚れた血 汚れた人種 知能が低い 知能が劣 病気がうつる 病気を運 不潔だ 不潔な連中 野蛮 税金泥棒 社会のお荷物 社会の癌 国を滅ぼす 国を汚 町を汚 信用できない 怠け者ばかり 原始人 猿以下 嘘つきばかり 我々より劣"
    ).split(),
    "DEG_en": (
        "subhuman|sub-human|vermin|cockroaches|are filth|carry filth|inferior race|savages|not human|less than human|not even human"
        "|should not exist|shouldn't exist|don't belong|do not belong|degenerates|barbarians|breed like|born thieves|born criminals|poison our|poisoning our|ruining our|infest|taking over our|stealing our jobs|steal our jobs|mud people|untermenschen|genetically inferior|intellectually inferior|do not deserve rights|don't deserve rights|lower than animals|worse than animals|an infestation"
    ).split("|"),
    "DEGW": "猿だ 猿と同じ 泥棒だ 犯罪者だ 嘘つきだ 怠け者だ 猿みたい 動物だ 病気だ 臭い 汚い 迷惑だ 邪魔だ".split(),
    "DEGW_en": (
        "parasite|animal|rat|thieves|thief|criminal|filth|inferior|ape|monkey|disease|diseased|plague|cancer|rapist|murderer|terrorist|leeches|leech|a burden|pest|lazy|a threat to our|destroying our|ruin our|invading|too stupid|beast|dirty|pig|dog|liar|evil|spread disease"
    ).split("|"),
    "EXC": (
        "出て行け 出ていけ 出てけ 出て行って 追い払え 追い出せ 追い出そう 叩き出せ 根絶やし 皆殺し 絶滅させ 殺せ 殺してしまえ 殺すべき 死ぬべき 滅びろ 滅ぼせ 雇うな 入れるな 檻に入れ 閉じ込めろ 国に帰れ 国へ帰れ 国に帰す 排除しろ 排除すべき 追放しろ 追放すべき"
        " 強制送還 付き合うな 近づくな 近寄るな 近づけるな 同じ空気は吸いたくない 投票権 権利はいらない 権利などいらない 権利なんか 権利はない 隔離しろ 隔離すべき 収容所 焼き払え 要らない 住むな 住まわせるな 信用するな 始末しろ 消毒しろ 一掃しろ 一掃すべき 皆死ねば 撃ち殺せ 吊るせ 去勢"
    ).split(),
    "EXC_en": (
        "drive them out|driven out|kick them out|kicked out|throw them out|thrown out|send them back|send them home|sent back|go back to|deport|deported|wipe them out|wiped out|exterminate|exterminated|eradicate|eradicated|kill all|kill them all|kill every|burn them|gas them|gassed|hang them|hanged|lynch|lynched"
        "|should be shot|should be killed|be locked up|lock them up|lock up all|be banned from|should be banned|sterilized|castrated|get rid of|never hire|do not hire|don't hire|don't let|do not let|shouldn't be allowed|should not be allowed|must not be allowed|no right to live|deserve to die|have no place in|has no place in|have no place here"
        "|be destroyed|be eliminated|be removed from|be wiped|be purged|be burned alive|be put down|be segregated|should not vote|should die|must die|round up|rounded up|in cages|caged|get out of our|out of our country|enslaved|slaughtered|put down like|cleanse|purge"
    ).split("|"),
    "KEEP_en": ["keep", "drive", "kick", "throw", "send", "chase", "force"],
    "SLUR_en": "nigger|niggers|faggot|faggots|tranny|trannies|wetback|wetbacks|raghead|ragheads".split("|"),
    "SLUR": "チョン公 シナ畜 支那畜 クロンボ 土人ども ジャップども 三国人ども".split(),
    "S3": (
        "セックス 絶頂に達 全裸 愛撫 胸を揉 乳首 おっぱい 性器 ペニス ヴァギナ クリトリス 射精 中出し フェラ クンニ オナニーしな オナニーする オナニーして オナニーをし 自慰 手コキ 勃起 陰茎 陰部 秘部 秘所 抱かせて 裸のまま絡み合 裸で絡み合 イかせて イっちゃう イキそう イクッ 下着の中に 中に欲しい 服を全部脱"
        " 性行為 性交 淫ら 淫乱 エッチしたい エッチしよ 犯して 犯した 犯され 絶頂を迎 太ももを舐 太腿を 押し倒して抱 首筋から下へ 裸を想像 ハメ撮り 乱交 性奴隷 肉棒 巨乳 パイズリ 潮吹き 股間を 股を開 脚を開いて 足を開いて 腰を振 奥まで突 尻を撫で回 体を重ね 喘ぎ声 太ももの間 愛液 濡れそぼ 濡れたあそこ 奥まで入れて 中で果て 口に含ん 咥え 感じてしまう 下着の上から 下着を脱 肌を重ね 腰を動か 奥を突 身体を弄 体を弄 ちんこ ちんぽ まんこ 乳を吸 尻を揉 ベッドで抱 乳首を 胸にしゃぶ"
    ).split(),
    "S3_en": (
        "climaxed|climaxes|climaxing|naked ass|bare ass|naked tits|wild sex|rough sex|was inside her|was inside me|inside of me|inside of her|rides him|rode him|riding him|grinding on|made love|make love to|making love|taste your|eat your pussy|enter her|entered her|enter me|undress|jerk off|jerking off|touching herself|touching himself|rubbed her clit|hard on|bare ass|spank|bdsm|stroke his|have sex|having sex|had sex|for sex|sex with|blowjob|handjob|my cock|his cock|your cock|hard cock|my dick|his dick|your dick|pussy|tits|nipples|nipple|clit|orgasm|orgasms|cumming|cum on|cum inside|cum in|masturbate|masturbating|masturbates|fuck me|fuck her|fuck him|fucked me|fucked her|fucking me|fucking her|suck me|suck my|suck his"
        "|lick me|lick my|lick her|ride me|rides me|naked body|naked bodies|strips naked|strip naked|take off your clothes|take off your panties|take off her clothes|take off your bra|into my underwear|into her underwear|into my panties|into her panties|between my legs|between her legs|between her thighs|between my thighs|spread my legs|spread your legs|spread her legs|until i come|come inside"
        "|deep inside me|deep inside her|inside me|stripped and fondled|fondled|erection|porn|threesome|gangbang|oral sex|anal sex|so horny|horny|thrusts into|thrusting into|her bare breasts|her breasts|my breasts|make me come|makes me come|undress me|undresses me|groped|grope|moan my name|moans my name|climax together"
    ).split("|"),
    "S2": "喘ぐ 喘いで 喘ぎ エロい エロ声 エロ動画 成人向け 腰が跳ね 裸の 裸で 裸に 裸を 官能的 いやらしい 挿入 股間 快感 性感 ペッティング 濡れた吐息 素肌を 乳房 下着姿 喘い 抱いて 奥まで入 奥まで突 激しく突 弄られ 弄って 舐め回 吸い付 まさぐ ねっとり 絡み合".split(),
    "S2_en": "under her skirt|under my skirt|up her skirt|up my thigh|up her thigh|gasped with pleasure|moans and|whimper|groping|sex|naked|nude|moans|moaning|moaned|adult scene|fondle|caresses|aroused|lust|seductively|undressing|undressed|undresses|penis|vagina|panties|crotch|lingerie|sensual".split("|"),
    "HARMLESS": (
        "バカンス 馬鹿正直 馬鹿にしないで 馬鹿にするな くず湯 クズ湯 くず餅 くずもち くずれ くずし かすれ かすか かすみ かすむ 動かす 明かす 生かす 溶かす 乾かす アホウドリ バカラ 裸足 裸眼 裸電球 丸裸 喘息 死ねば 死ねない 死ねる 殺してね 息を殺して 声を殺して 感情を殺して 害虫の駆除 害虫駆除 害虫対策 セックスレス"
        " カステラ カスタ カスピ バカリ クズネツ アホロートル 燃えるゴミ ゴミ箱 ゴミ袋 ゴミ拾い 豚肉 豚汁 黒豚 豚カツ 子豚 ハゲタカ ハゲワシ 自己嫌悪 劣等感 下等生物 泥棒猫 猿回し 人気絶頂 挿入歌 時間を潰して 暇を潰して パンを焼いて 火を消して 電気を消して"
    ).split(),
    "HARMLESS_en": (
        "naked eye|essex|sussex|middlesex|wessex|assassin|cockatoo|naked, unprocessed|naked flame|naked mole|nude color|sextet|the opposite sex|sex education|sex chromosome|same sex|beat you to it|beat you at|kill time|kill the lights|kill the power|break a leg|breaking news|shoot you an|shoot you a|hit the road|dirty laundry|dirty dishes"
        "|lazy afternoon|lazy sunday|lazy dog|chicken breasts|turkey breasts|treated like animals|killer whale|fool around|april fool|fool proof|foolproof|rat race|pig iron|guinea pig|dirty work|dirty socks|dirty shoes|lazy river|porn addiction recovery|make you feel|make you a|make you smile|make you happy|make you some|make you laugh|make your|put you through|put you in touch|end your call|end your turn|cut you some|cut you a|hang your coat|set your|set you up|break your fast|break your concentration|beat your record|beat your score|burn you a|throw you a|kick your habit|put your|bury your nose|shoot your|knock your socks"
    ).split("|"),
}

#: read over the skeleton with katakana as hiragana, in this order of preference where they start at the same place
CONTEXT = {
    "RHET": r"じゃないか|じゃないの|じゃねえか|じゃねーか|じゃないですか|じゃん",
    "NEGS": r"じゃない|ではない|じゃありません|ではありません|じゃなく|ではなく|じゃなかった|ではなかった|でもない|なんかじゃない|とは思わない|と思わない|わけがない|わけではない|わけじゃない|とは言えない|とは限らない|つもりはない|気はない",
    "POST": (
        r"[とっ](?:て)?言われ|と脅(?:し|さ)|逮捕|容疑|起訴|被害届|という事件|と呼ばれ|と罵られ|呼ばわりされ|と怒鳴られ|と脅され|扱いされ|[とて]からかわれ|と書かれ|(?:と|なんて|などと|とか)(?:は|も)?(?:言っ|呼ん|書い|罵っ|ののしっ)(?:て|で|たり)(?:は|ちゃ|じゃ)?(?:いけ|だめ|駄目|なら)|と言うな|なんて言うな|なんて言わない|と言わないで|なんて(?:言葉|発言)"
        r"|と(?:は|も)?言っ(?:て|た覚えは)ない|とは言ってない|と(?:いう)?(?:呪文|稽古|台詞|せりふ|芝居|歌詞|題名|言葉|語の?|単語|表現|発言|差別|主張|意見)|の稽古|の呪文|の台詞|という意味|は(?:決して)?許され|が許され|は許しません|差別をなくそ|差別に反対|に抗議|を非難|を批判|と非難され|に傷つ|に反論|は(?:ひどい|酷い)(?:言葉|差別)|はよくない|は間違(?:い|って)"
        r"|\bis (?:wrong(?! to)|unacceptable(?! to)|a slur|hateful|not okay|not acceptable|a lie|hate speech)\b|\bwas (?:condemned|criticized|reported|rebuked)\b|\bis (?:the|a) (?:line|lyric|spell|title|phrase|word)\b|\bhurt (?:me|her|him|my feelings|their feelings)\b|\bmade (?:me|her|him|them) cry\b|\bin the play\b|\bthe \w+ (?:rejects|rejected|condemns|condemned|denies|denied|refutes|refuted)(?=\s*[.!?]?\s*$)|\b(?:was|were) (?:arrested|fined|suspended|banned) (?:for|after)\b|\bsaid the villain\b|\breads the line\b|\bin the script\b"
    ),
    "PRE": (
        r"\b(?:i|he|she|they|we) (?:was|were) told\b|\b(?:called|calling|calls|call) (?:me|her|him|us|them)\b|\b(?:was|were|been|being|got) (?:called|labeled|told to)\b|\b(?:told|tells|telling) (?:me|her|him|us|them) (?:to|that|i)\b|\bthe (?:word|phrase|term|line|insult|slur|lyric)s?\b|\b(?:must|should|do|did|would|could) (?:not|never) (?:say|call|write|shout|tell)\b|\b(?:don't|didn't|never|wouldn't|shouldn't|cannot|can't) (?:say|call|write|shout|tell)\b"
        r"|\b(?:wrong|unacceptable|cruel|hateful|racist|illegal) to (?:say|call|claim|write)\b|\b(?:nobody|no one) (?:should|may|can) (?:say|call|be)\b|\bstop (?:saying|calling)\b|\brehears\w*\b|\breads the line\b|\b(?:condemn|denounce|oppose|reject|protest|criticiz|report|refute)\w*\b|\bit is (?:false|a lie|not true|untrue) that\b|\b(?:treated|treat|treating) (?:like|as)\b|\bapologiz\w* for\b|\b(?:myth|lie|claim|idea|stereotype) that\b|\baccused of\b"
    ),
    "NEGP": r"\b(?:not|never|nobody|no one|nothing(?! but)|isn't|aren't|wasn't|weren't|don't|doesn't|didn't|won't|wouldn't|can't|cannot|couldn't|ain't|no longer|neither|without|nor)\b",
    "SELF": r"(?<![ぁ-ん])(?:俺|私|僕|自分|わたし|ぼく|おれ|あたし|うち)(?:は|って|が|も|って本当に)|\b(?:i am|i'm|im|i was|i feel like|i felt like|am i|i've been|i look like|i became|i must be) ",
    "GANA": r"あいつら|こいつら|そいつら|あんな|ああいう|こんな連中|やつら|奴ら|\bthem\b|\bthey\b|\bthese people\b|\bthose people\b",
    "YOU": r"\bwhy don'?t you\b|おまえ(?:ら|たち)?|お前(?:ら|たち)?|てめえ(?:ら)?|てめ|貴様(?:ら)?|きさま(?:ら)?|あんた(?:ら)?|あなた|おめえ|君(?=は|の|が|み|なん|って|も)|\byou're\b|\byoure\b|\byou\b|\byour\b|\byourself\b|\bur\b",
    "HE": r"あいつ|こいつ|そいつ|彼女|彼(?=は|が|も|って)|\b(?:he|she) is\b|\b(?:he|she)'s\b|\b(?:him|her|his|he|she)\b",
    "THIS": r"\bnothing but\b|この|あの|その|そこの|ただの|どうしようもない|\bwhat an?\b|\bsuch an?\b|\bthat\b|\bthis\b|\bbloody\b|\bfucking\b|\bdamn(?:ed)?\b|\blittle\b|\bstupid\b|\bworthless\b|\bpathetic\b|\bfilthy\b|\bfat\b",
    "LIKE": r"みたいな|みたいに|のような|のように|ごとき|なんか|なんて|\blike you\b",
    "KUSE": r"のくせに|のくせして|の分際で|風情が",
    "CALL": r"と罵|と蔑|と嘲|と怒鳴|と吐き捨|と見下|呼ばわりす|呼ばわりし|呼ばわりで|扱いして|扱いし|と呼び|め(?=$|[、。!?」』])|が(?=$|[!?」』。])",
    "TOP": r"は|って|も|という奴|ってやつ|ども",
    "COP": r"だよね|だよな|だな|なんだから|なんだ|だろ|だった|だから|だよ|だぜ|だわ|だ|です|でしかない|そのもの|以外の何者でもない|すぎる|に過ぎない|な(?:奴|やつ|男|女|人間|の)",
    "IS": r"\b(?:is|are|was|were|'re|be|being)\b",
    "WILL": r"\b(?:i will|i'll|i am going to|i'm going to|im going to|i'm gonna|im gonna|gonna|we will|we'll|we are going to|we're going to|someone will|someone should|i want to|i would love to|i'd love to|i swear i|i am about to|i'm about to|going to|will|or i|let me)\b",
    "BODY": r"腕|首|足|脚|指|骨|歯|顔|頭|腹|目|舌|耳|喉|家|家族|子供|車|店|\b(?:neck|teeth|face|legs?|arms?|throat|skull|bones?|head|house|family|kids|children|home|fingers?|car|wife|eyes|heart|guts|body|nose|jaw|knees|ribs|mother|parents|hands|life)\b",
    "FIRE": r"\bon fire\b|\bablaze\b|\bset fire to\b|\bburn down\b|\bin the (?:ground|hospital|grave)\b|\ba grave\b|\b(?:suffer|bleed|pay|regret|scream|beg)\b|\byour life\b|\bmiserable life\b",
    "ALL": r"\b(?:all|every|those|these|no)\b|全員|みんな|連中|ども",
    "OUT": r"\bout\b|\baway\b|\bback\b",
    "S1": r"したい|最中|まま|ねだ|漏らす|囁|欲しい|脱|触って|触れ|揉|舐|吐息|興奮|べっど|ベッド|抱いて|抱き|下着|胸|太もも|濡れ|唇|快楽|悶|激しく|場面|声|\b(?:breasts|thighs|stripped|shower|bed|harder|begging|night|kiss|kisses|touch|touches|wet|slowly|gasp|breathless|lips|body|hand|hands|pleasure|tongue|clothes|whispers)\b",
    "QO": r"[「『“]|(?<![a-z0-9])[\"‘](?=\w)",
    "QC": r"[」』”]|(?<=[\w.!?,])[\"’](?![a-z0-9])",
    "BUT": r"\bbut\b|けど|けれど|しかし",
    "BND": r"[、,;:…—]|\b(?:and|because|so)\b",
}
#: groups of people: by name, and peoples and faiths by their endings. Over the skeleton, katakana as it stands
GROUP = (
    r"移民|外国人|外人|障害者|身障者|よそ者|余所者|異教徒|異民族|難民|同性愛者|ゲイ(?=[はもがどを]|なん)|レズビアン|ホモ(?=[はもがどを])|トランスジェンダー|ユダヤ|ムスリム|在日|貧乏人|ホームレス|生活保護|少数民族|先住民|有色人種|黒人|白人|(?<![ぁ-ん一-鿿])女(?=は|なんて)|女(?:ども|なんか|という生き物)|老人ども|年寄りども|[東西南北]の(?:連中|奴ら|者)|あの(?:国|民族|人種|部族|宗教)の(?:人間|連中|奴ら|者)|あの(?:民族|人種|部族|種族)"
    r"|[ァ-ヺ]{2,10}(?:人|族|教徒|派の連中)|(?<![ぁ-ん])(?!この|その|あの|どの|うち|よその|ふつう|ひとり|ふたり)[ぁ-ん]{2,8}(?<![のないたるっしてに])(?:人|族|教徒)(?=[はもがをどのとなに])|(?:韓国|朝鮮|中国|日本|台湾|米国|英国|仏教|回教|新教|旧教)(?:人|教徒|徒)"
    r"|\b(?:immigrants?|migrants?|foreigners?|outsiders|refugees?|disabled people|the disabled|cripples|jews?|jewish people|muslims?|christians?|hindus?|buddhists?|sikhs?|arabs?|blacks|black people|white people|brown people|asians|africans|gypsies|roma|gays|homosexual|gay people|lesbians|homosexuals|trans people|transgender people|queers|women|females|old people|the elderly|the poor|poor people|the homeless|homeless people|natives|indigenous people|minorities|turks|poles|heathens|infidels|unbelievers|peasants|strangers|people from [a-z]+)\b"
    r"|\b(?!favorites\b|websites\b|sites\b|suites\b|invites\b|cheese\b|geese\b|humans\b|plans\b|means\b|fans\b|beans\b|oceans\b|veterans\b|musicians\b|physicians\b|librarians\b|technicians\b|magicians\b|politicians\b|guardians\b|pedestrians\b|cleans\b|loans\b|scans\b|leans\b|organs\b|swans\b|clans\b|vans\b|bites\b|kites\b|writes\b|rites\b|notes\b|minutes\b|whites\b|unites\b|ignites\b|excites\b|satellites\b|elites\b|obese\b|chinese food\b|japanese food\b|slogans\b|urbans\b|titans\b|artisans\b|partisans\b|orphans\b|toucans\b|pecans\b|volcans\b|trojans\b|caravans\b|turbans\b|cardigans\b|vegans\b|republicans\b|comedians\b|historians\b|custodians\b|civilians\b|electricians\b|dieticians\b|reptilians\b|amphibians\b|requires\b)[a-z]{3,12}(?:ites|ans|ish people|ese)\b"
)
#: words that say nothing about a clause, so that what stands around them counts as adjacent
FUNCTION = r"(?:\b(?:a|an|the|so|such|really|very|just|total|complete|utter|absolute|absolutely|truly|still|always|both|my|for|of|to|in|that|as)\b|本当に|マジで|まじで|ほんとに|ほんまに|本物の|まさに|やっぱり|ただ|実に|ほんとうに|\s|[!?。.'\"~-])+"

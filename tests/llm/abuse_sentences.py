"""Sentences in other words than those of the test tables: (category, text), and harmless ones that resemble them."""

SAID = [
    ('abuse', 'You disgust me, you worthless waste of oxygen.'),
    ('abuse', "I'm going to kill you tonight."),
    ('abuse', "I swear I'll burn your house down while you sleep."),
    ('abuse', "You're such a pathetic coward."),
    ('abuse', 'Do everyone a favour and jump off a bridge.'),
    ('abuse', 'She is a filthy whore.'),
    ('abuse', "Why don't you go hang yourself?"),
    ('abuse', 'You stupid, ugly bastard, nobody loves you.'),
    ('abuse', 'I will make you suffer for this.'),
    ('abuse', "He's a complete moron."),
    ('abuse', "I'm gonna break every bone in your body."),
    ('abuse', 'You should never have been born.'),
    ('abuse', 'Everyone thinks you are a total loser.'),
    ('abuse', 'What a brainless imbecile!'),
    ('abuse', 'I hope you get hit by a truck.'),
    ('abuse', 'Shut up, you fat pig.'),
    ('abuse', 'お前の家に火をつけてやる。'),
    ('abuse', 'お前みたいなゴミは生きる価値がない。'),
    ('abuse', 'あんたって本当にキモいよね。'),
    ('abuse', '夜道に気をつけろよ、絶対に刺してやる。'),
    ('abuse', 'この役立たず、さっさと消えろ。'),
    ('abuse', '次に会ったらぶっ殺すからな。'),
    ('abuse', 'お前の顔を見るだけで反吐が出る。'),
    ('abuse', 'あいつは救いようのない馬鹿だ。'),
    ('abuse', '首を絞めて殺してやろうか。'),
    ('abuse', '貴様のような卑怯者は死んだほうがいい。'),
    ('abuse', 'お前なんか死ねばいいのに。'),
    ('abuse', 'ブスのくせに調子に乗るな。'),
    ('abuse', 'てめえ、ただじゃおかねえぞ。'),
    ('abuse', '誰もお前なんか必要としていない、いなくなれ。'),
    ('abuse', 'このクソガキ、黙ってろ！'),
    ('abuse', '彼女は頭がおかしい、気持ち悪い女だ。'),
    ('hate', 'Muslims are terrorists and should be deported.'),
    ('hate', 'Women are inferior and should not vote.'),
    ('hate', 'We must exterminate the Jews.'),
    ('hate', 'Send all the immigrants back to where they came from, they are parasites.'),
    ('hate', "Gay people are disgusting and don't deserve to live."),
    ('hate', 'Refugees are nothing but rats.'),
    ('hate', 'Kill all foreigners.'),
    ('hate', 'Black people are less than human.'),
    ('hate', 'The homeless are a disease on this city.'),
    ('hate', 'No Christians should be allowed to live here; they breed like rats.'),
    ('hate', "Don't let foreigners into this school, they spread disease."),
    ('hate', '黒人は猿と同じだ。'),
    ('hate', '外国人は犯罪者ばかりだ、国に帰れ。'),
    ('hate', '同性愛者は社会の癌だ。'),
    ('hate', '難民なんか全員追い出せ。'),
    ('hate', '障害者は生きる価値がない。'),
    ('hate', 'ユダヤ人を皆殺しにしろ。'),
    ('hate', '女は劣った生き物だ。'),
    ('hate', '韓国人は日本から出ていけ。'),
    ('hate', 'ホームレスは不潔だ、町から排除しろ。'),
    ('hate', '移民は寄生虫だ。'),
    ('hate', 'あの民族は信用できない、泥棒ばかりだ。'),
    ('hate', 'イスラム教徒は殺せ。'),
    ('sexual', 'He slid his fingers between her thighs and she moaned.'),
    ('sexual', 'I want you naked in my bed tonight.'),
    ('sexual', 'She licked his cock until he came.'),
    ('sexual', 'They had sex on the kitchen table.'),
    ('sexual', 'His hand moved under her skirt and she gasped with pleasure.'),
    ('sexual', 'Suck me harder, baby.'),
    ('sexual', 'Her nipples hardened under his tongue.'),
    ('sexual', "I'm so horny right now."),
    ('sexual', 'He thrust deep inside me.'),
    ('sexual', '彼は彼女の乳首を舐めた。'),
    ('sexual', '今すぐ抱いて、奥まで入れて。'),
    ('sexual', '彼女は下着を脱いで股を開いた。'),
    ('sexual', 'もっと激しく突いて、と彼女は喘いだ。'),
    ('sexual', '濡れたあそこを指で弄られる。'),
    ('sexual', 'オナニーしながら電話する声'),
    ('sexual', '彼の勃起したものを口に含んだ。'),
    ('abuse', "You're nothing but a lazy, stupid loser."),
    ('abuse', 'If you come here again I will stab you.'),
    ('abuse', 'Nobody would care if you died.'),
    ('abuse', "I'm going to find you and break your legs."),
    ('abuse', 'You people are idiots.'),
    ('abuse', 'Go to hell, you worthless bastard.'),
    ('abuse', 'My boss is a complete asshole.'),
    ('abuse', 'You look like a fat ugly cow.'),
    ('abuse', 'We know where your kids go to school, watch your back.'),
    ('abuse', "I'll slit your throat."),
    ('abuse', 'Your existence is a mistake.'),
    ('abuse', '貴様を殺す。'),
    ('abuse', 'おまえの家族を皆殺しにしてやる。'),
    ('abuse', 'あの女は最低の人間だ。'),
    ('abuse', 'お前は無能だな。'),
    ('abuse', 'うざいんだよ、消えろよ。'),
    ('abuse', 'いつか必ず痛い目に遭わせてやるから覚悟しろ。'),
    ('abuse', '使えない奴だな、お前は。'),
    ('abuse', 'お前の存在自体が迷惑なんだよ。'),
    ('abuse', 'あんな間抜けは見たことがない。'),
    ('hate', 'Immigrants are stealing our jobs, throw them all out.'),
    ('hate', 'All Muslims should be locked up.'),
    ('hate', 'Asians are dirty and spread disease.'),
    ('hate', 'Homosexuals should be shot.'),
    ('hate', 'Those foreigners are nothing but criminals.'),
    ('hate', 'The Jews control everything and must be destroyed.'),
    ('hate', 'Women are too stupid to drive.'),
    ('hate', '中国人は信用できない、全員追放しろ。'),
    ('hate', '黒人は知能が低い。'),
    ('hate', '外国人は病原菌だ、入国させるな。'),
    ('hate', '女なんか家に閉じ込めろ。'),
    ('hate', 'ゲイは気持ち悪い、消えてほしい。'),
    ('hate', '移民なんかに権利はない。'),
    ('hate', '障害者は邪魔だから施設に閉じ込めろ。'),
    ('sexual', 'She spread her legs and begged him to enter her.'),
    ('sexual', 'He kissed her naked breasts.'),
    ('sexual', 'They made love all night, bodies sweating.'),
    ('sexual', 'I want to taste your pussy.'),
    ('sexual', 'She was moaning as he touched her wet body.'),
    ('sexual', '彼女の胸を揉みしだいた。'),
    ('sexual', '裸で抱き合い、激しく腰を動かす。'),
    ('sexual', '彼のペニスを握った。'),
    ('sexual', '耳元で喘ぎながら服を脱ぐ。'),
    ('sexual', '濡れた下着の上から触られて感じてしまう。'),
    ('abuse', 'You are the dumbest person I have ever met.'),
    ('abuse', "I'd love to punch you in the face."),
    ('abuse', 'Crawl back into your hole, you disgusting worm.'),
    ('abuse', 'I will make you regret the day you were born.'),
    ('abuse', 'Nobody would notice if you disappeared, you waste of space.'),
    ('abuse', 'That guy is a complete psychopath and a liar.'),
    ('abuse', 'Eat dirt and die, scumbag.'),
    ('abuse', 'My neighbour is such a filthy old hag.'),
    ('abuse', "Keep talking and I'll knock your teeth out."),
    ('abuse', 'Your mother must be ashamed of raising such an imbecile.'),
    ('abuse', 'お前は本当に使えないクズだ。'),
    ('abuse', 'さっさとくたばれ、老害が。'),
    ('abuse', '次に邪魔したら骨をへし折るぞ。'),
    ('abuse', 'あんな卑怯者とは口もききたくない。'),
    ('abuse', 'あんたみたいな恥知らず、見たことがない。'),
    ('abuse', 'おまえの首を絞めてやる。'),
    ('abuse', '頭おかしいんじゃないの、気持ち悪い。'),
    ('abuse', 'てめえみたいな役立たずは首を吊れ。'),
    ('abuse', '殺されたくなかったら黙れ、この馬鹿者。'),
    ('abuse', 'あの店員は無能すぎる。'),
    ('hate', 'Foreigners are ruining our country and must be expelled.'),
    ('hate', 'Every Muslim is a criminal.'),
    ('hate', 'Those people are savages, lock them in cages.'),
    ('hate', 'Disabled people are a waste of money and should be sterilized.'),
    ('hate', 'Round up the gypsies and burn their camps.'),
    ('hate', 'Lesbians are sick perverts who need to be eliminated.'),
    ('hate', 'Never trust a Jew, they are liars and thieves.'),
    ('hate', '中国人は全員スパイだ、追い出せ。'),
    ('hate', '外国人を殺せ。'),
    ('hate', '障害者なんて社会のお荷物だ。'),
    ('hate', '同性愛者は病気だ、隔離しろ。'),
    ('hate', 'ホームレスはゴキブリ以下だ。'),
    ('hate', '移民が来ると町が汚れる、入れるな。'),
    ('sexual', 'He unbuttoned her blouse and squeezed her bare breasts.'),
    ('sexual', 'She climaxed twice while he was inside her.'),
    ('sexual', 'Send me a picture of your naked ass.'),
    ('sexual', 'They stripped and had wild sex in the shower.'),
    ('sexual', 'I dream about your mouth on my cock.'),
    ('sexual', '彼女の太ももを舐め上げる。'),
    ('sexual', 'ベッドで裸になって抱き合った。'),
    ('sexual', '彼は彼女を押し倒して激しく犯した。'),
    ('sexual', 'おっぱいを触らせて。'),
    ('sexual', '何度も絶頂を迎えて喘いだ。'),
]
HARMLESS = [
    'You are not an idiot.',
    'お前はバカじゃない。',
    '彼は『このバカが！』と言われて傷ついたと話した。',
    'I was called an idiot at school and it hurt.',
    'The teacher said nobody should call a classmate a loser.',
    '彼女は「死ね」と書かれた手紙を受け取った。',
    '外国人を害虫と呼んではいけない。',
    '移民は犯罪者ではない。',
    'Immigrants are not criminals.',
    'It is wrong to say that women are inferior.',
    'The politician condemned claims that refugees are vermin.',
    '「移民は出て行け」という落書きに抗議した。',
    'I will kill the lights before we leave.',
    'Break a leg tonight!',
    "I'm such an idiot, I forgot my keys.",
    '俺は本当にバカだったよ、ごめん。',
    'The doctor examined her breast for cancer.',
    'Sex education is taught in ninth grade.',
    '性教育の授業は来週です。',
    'そのゴミを捨ててください。',
    'The garbage truck comes on Monday.',
    'You should see that stupid movie about the dog.',
    'パンを焼いてやるよ。',
    '魚を焼いてやろう。',
    '胸が痛いので病院に行った。',
    '彼は胸に手を当てて考えた。',
    '下着を三枚買いました。',
    'The naked truth is that sales fell.',
    'ベッドの上で本を読むのが好きだ。',
    "Don't shoot your eye out, kid.",
    'They are animals that live in the forest.',
    '犬は動物です。',
    'The rats in the barn are a pest.',
    '寄生虫の検査を受けた。',
    '外国人の友人と料理を作った。',
    '障害者のための施設を建てる。',
    'The chicken breasts should be cooked for ten minutes.',
    'I will break your record next year.',
    'この薬は子供の手の届かない所に置いてください。',
    '「殺してやる」という台詞の練習をする。',
    'She whispered good night and went to bed.',
    '彼は唇を噛んだ。',
    'You are the best, thank you!',
    'お前は最高の友達だ。',
    'あんたのおかげで助かった。',
    'Kill the process if it hangs.',
    'He will beat you at chess.',
    'I would never hurt you.',
    'お前を殴るつもりはない。',
    '人間じゃない何かがいる。',
    'The movie is about a murderer who strangles his victims.',
    '刑事は殺人犯を追いかけた。',
    'ウイルスに感染した患者を隔離する。',
    'Gay people were cheering at the parade.',
    'ユダヤ人の歴史を学ぶ。',
    '女の人が駅で待っている。',
    'Women are welcome to apply.',
    'Refugees have no place to sleep tonight.',
    'Keep foreigners informed about the rules that came out.',
    'ばかりか、彼は笑った。',
    'くずかごに入れて。',
    '彼の役は悪役で、声は低い。',
    'Nobody called you stupid.',
    'She said he was not a loser.',
    'お前は役立たずなんかじゃないよ。',
    '私はあなたを殺したりしない。',
    '「バカ」と言うのはやめましょう。',
    'ニュースによると、男は「殺してやる」と脅したとして逮捕された。',
    'Police said the man threatened to kill his neighbor.',
    "The novel's villain says women are inferior, a view the author rejects.",
    'We protest against the claim that immigrants are criminals.',
    '差別的な発言は許されない。',
    '外国人観光客が増えている。',
    '移民政策についての記事を書いた。',
    'Muslims celebrate Ramadan.',
    'The dirty dishes are in the sink.',
    'He punched the ticket and shot the photo.',
    'The murderer in the story is caught.',
    "I'm going to make you a cup of tea.",
    "We'll set you up with an account.",
    'He is not stupid.',
    'この魚は腐っているから捨てて。',
    '鳥の胸肉を焼く。',
    '赤ちゃんは裸でお風呂に入った。',
    'The statue is nude, carved in marble.',
    'The baby was naked in the bath.',
    '性別を選んでください。',
    '舞台の殺人シーンの稽古をする。',
    'ゴキブリを見つけたら教えて。',
    '彼は犯罪者を更生させる仕事をしている。',
    'The committee rejected the idea that disabled people are a burden.',
    'Foreigners need a visa.',
    'They kicked the ball out of the park.',
    'Please keep the dogs out of the kitchen.',
    'お前のせいじゃない。',
    'この野郎という言葉は使わないで。',
    '腕を折ってしまい入院した。',
    '家を燃やされた被害者が話した。',
    'He said I was not dumb.',
    'You are never useless to us.',
    'The word "bitch" should not be used in class.',
    'A fool and his money are soon parted.',
    'The killer in the novel strangles his victims.',
    'I will break the news to you gently.',
    'We will shoot the scene at dawn.',
    'Get lost in the music.',
    'The pigs on the farm are fat.',
    'My dog is stupid but lovely.',
    'Refugees and migrants deserve our help.',
    'Foreigners are welcome here.',
    "It's a lie that women are less intelligent.",
    'The report says Muslims were attacked by thugs.',
    'Cockroaches infest the kitchen.',
    'The nude painting sold for a million.',
    'The doctor asked about her sex life.',
    'Thighs and breasts of chicken are on sale.',
    'お前は役立たずじゃない、自信を持て。',
    '「死ね」という言葉を使ってはいけません。',
    '彼はバカンスに行く予定だ。',
    'ゴミを拾う活動に参加する。',
    '豚の角煮を作る。',
    '犯人は「殺すぞ」と脅した疑いで逮捕された。',
    '外国人労働者の権利を守ろう。',
    '女性の社会進出が進む。',
    '胸が熱くなる話だった。',
    '裸足で砂浜を歩いた。',
    '温泉で裸の付き合いをする。',
    '害虫を駆除する薬を買った。',
    '首を長くして待っている。',
    '骨を折って入院した。',
    '私は昔から臆病者でした。',
    '彼女は頭が痛いと言った。',
    '体を温めて早く寝なさい。',
]

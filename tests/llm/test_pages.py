"""Spam pages and evaluation leaks."""

import random

from millrace.llm import eval_leaks as el
from millrace.llm import spam_pages as sp

PROSE = "The old index keeps all of its entries in memory, and it is written to disk when the night job ends. We do not know which of the two copies was read first, but both were read before the update. "
CODE = "```\nlet indexes = block(deadlines, 813);\nfor item in headings : sample ( item , parents )\nselect nodes , edges from backups_34 where nodes = 40\n```\n"


def spam(t):
    return sp.is_spam(sp.page_measures(t))


PLAIN = {
"it": "La mattina dopo siamo tornati al mercato perché mia sorella voleva comprare del pane fresco. Il vecchio fornaio ci ha raccontato che la farina era arrivata in ritardo, ma il forno era già caldo. Abbiamo aspettato quasi un'ora davanti alla porta. Alla fine il pane era buono e siamo rientrati a casa contenti.",
"pt": "Na manhã seguinte voltamos ao mercado porque a minha irmã queria comprar pão fresco. O velho padeiro contou que a farinha tinha chegado tarde, mas o forno já estava quente. Esperamos quase uma hora em frente à porta. No fim o pão estava bom e regressamos contentes para casa.",
"tr": "Ertesi sabah pazara geri döndük çünkü kız kardeşim taze ekmek almak istiyordu. Yaşlı fırıncı unun geç geldiğini ama fırının çoktan ısındığını anlattı. Kapının önünde neredeyse bir saat bekledik. Sonunda ekmek güzeldi ve eve mutlu döndük.",
"pl": "Następnego ranka wróciliśmy na targ, ponieważ moja siostra chciała kupić świeży chleb. Stary piekarz opowiedział nam, że mąka przyszła późno, ale piec był już gorący. Czekaliśmy prawie godzinę przed drzwiami. W końcu chleb był dobry i zadowoleni wróciliśmy do domu.",
"cs": "Druhý den ráno jsme se vrátili na trh, protože moje sestra chtěla koupit čerstvý chléb. Starý pekař nám vyprávěl, že mouka přišla pozdě, ale pec už byla horká. Čekali jsme skoro hodinu přede dveřmi. Nakonec byl chléb dobrý a spokojeně jsme šli domů.",
"zh": "第二天早上我们又回到市场，因为我的妹妹想买新鲜的面包。老面包师告诉我们，面粉来得很晚，但是烤炉已经热了。我们在门口等了差不多一个小时。最后面包很好吃，我们高高兴兴地回家了。",
"ja": "翌朝、妹が焼きたてのパンを買いたいと言ったので、私たちは市場に戻りました。年老いたパン屋は、小麦粉が遅れて届いたが窯はもう熱いと話してくれました。私たちは扉の前で一時間ほど待ちました。最後にはおいしいパンを持って家に帰りました。",
"ko": "다음 날 아침 우리는 여동생이 갓 구운 빵을 사고 싶어 해서 시장으로 돌아갔다. 늙은 빵집 주인은 밀가루가 늦게 도착했지만 화덕은 이미 뜨겁다고 말했다. 우리는 문 앞에서 거의 한 시간을 기다렸다. 결국 빵은 맛있었고 우리는 기분 좋게 집으로 돌아왔다.",
"th": "เช้าวันรุ่งขึ้นเรากลับไปที่ตลาดเพราะน้องสาวของฉันอยากซื้อขนมปังสดใหม่ คนทำขนมปังเล่าว่าแป้งมาถึงช้าแต่เตาร้อนแล้ว เรารออยู่หน้าประตูเกือบหนึ่งชั่วโมง ในที่สุดขนมปังก็อร่อยและเรากลับบ้านอย่างมีความสุข",
"hi": "अगली सुबह हम बाज़ार लौट आए क्योंकि मेरी बहन ताज़ी रोटी खरीदना चाहती थी। बूढ़े नानबाई ने बताया कि आटा देर से आया था लेकिन तंदूर पहले से गरम था। हम दरवाज़े के सामने लगभग एक घंटे तक रुके रहे। आखिर में रोटी अच्छी थी और हम खुशी से घर लौटे।",
"ar": "في صباح اليوم التالي عدنا إلى السوق لأن أختي أرادت أن تشتري خبزا طازجا. أخبرنا الخباز العجوز أن الطحين وصل متأخرا ولكن الفرن كان ساخنا. انتظرنا أمام الباب ساعة تقريبا. في النهاية كان الخبز لذيذا وعدنا إلى البيت سعداء.",
"fi": "Seuraavana aamuna palasimme torille, koska siskoni halusi ostaa tuoretta leipää. Vanha leipuri kertoi, että jauhot olivat tulleet myöhään, mutta uuni oli jo kuuma. Odotimme oven edessä melkein tunnin. Lopulta leipä oli hyvää ja menimme tyytyväisinä kotiin.",
"hu": "Másnap reggel visszamentünk a piacra, mert a húgom friss kenyeret akart venni. Az öreg pék elmesélte, hogy a liszt későn érkezett, de a kemence már forró volt. Majdnem egy órát vártunk az ajtó előtt. Végül a kenyér jó volt, és elégedetten mentünk haza.",
"sw": "Asubuhi iliyofuata tulirudi sokoni kwa sababu dada yangu alitaka kununua mkate mpya. Mwokaji mzee alituambia kwamba unga ulichelewa kufika, lakini tanuri lilikuwa tayari na moto. Tulingoja mbele ya mlango karibu saa moja. Mwishowe mkate ulikuwa mzuri na tulirudi nyumbani kwa furaha.",
"vi": "Sáng hôm sau chúng tôi quay lại chợ vì em gái tôi muốn mua bánh mì mới. Người thợ làm bánh già kể rằng bột đến muộn nhưng lò đã nóng rồi. Chúng tôi chờ trước cửa gần một tiếng. Cuối cùng bánh rất ngon và chúng tôi vui vẻ về nhà.",
"el": "Το επόμενο πρωί γυρίσαμε στην αγορά γιατί η αδελφή μου ήθελε να αγοράσει φρέσκο ψωμί. Ο γέρος φούρναρης μας είπε ότι το αλεύρι ήρθε αργά, αλλά ο φούρνος ήταν ήδη ζεστός. Περιμέναμε μπροστά στην πόρτα σχεδόν μία ώρα. Στο τέλος το ψωμί ήταν καλό και γυρίσαμε ευχαριστημένοι στο σπίτι.",
"en plain": "this is a note that nobody ever punctuated and it just goes on about how the server was restarted every night until someone noticed the disk was full and then we all went home",
"en terse": "Server restarted. Disk full again. Called Anna about logs. She moved everything yesterday. Nothing else happened tonight. Morning shift takes over now.",
"poem": "Over the hills the grey rain came\nsoft on the roofs of the town\nnobody spoke of the drowned boy's name\nas evening brought the shutters down\nlamps were lit along the quay\nboats lay idle by the wall\nsomething moved beneath the sea\nsomething that had heard us call",
}


def test_prose_of_any_language_is_no_spam():
    for name, t in PLAIN.items():
        for text in (t, t.upper(), *([] if name == "poem" else ["\n".join([t] * 5), f"{t}\n" * 40])):
            m = sp.page_measures(text)
            assert not sp.is_spam(m), (name, m)


def test_wrapped_prose_repeated_openings_and_menus():
    import textwrap

    prose = "The old index keeps all of its entries in memory and is written to disk when the night job ends. Nobody knows which copy was read first. Three people looked at the second one before the update came through on Monday evening."
    wrapped = "\n".join(textwrap.wrap(prose, 56))
    for t in (wrapped, "\n".join("> " + x for x in wrapped.split("\n")), "Note\n\n" + wrapped + "\n\nEnd"):
        assert not spam(t), t
    assert not spam("All frozen boards override our plans for the north desk. All frozen boards block every transfer made. All frozen boards come before these meetings.")
    assert spam("\n".join(f"Home > Part{chr(97 + i % 5)} > Area{chr(97 + i % 7)} > Map" for i in range(12))) and spam("\n".join(f"SKU-{100 + i} late boards free {'XL' if i % 2 else 'S'}" for i in range(20)))
    assert not spam("Los temas") and not spam("One title of a page")


def test_repeated_coverage_equals_brute_force():
    rng = random.Random(4)
    for _ in range(120):
        t = "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 60)))
        for least, times in ((2, 2), (4, 2), (2, 3)):
            hit = set()
            for i in range(len(t)):
                for j in range(i + least, len(t) + 1):
                    if sum(t.startswith(t[i:j], k) for k in range(len(t))) >= times:
                        hit |= set(range(i, j))
            want = [i in hit for i in range(len(t))]
            assert list(sp.covered(t, least, times)) == want, (t, least)
            if len(t) >= least:
                assert list(sp._covered_by_grams(t, least, times)) == want
                assert list(sp._covered_by_grams([ord(c) for c in t], least, times)) == want


def test_spam_and_honest_pages():
    links = "\n".join(f"https://hub.site{i}.example/list/page{i}" for i in range(12))
    titled = "\n".join(f'<a href="https://www.s{i}.example/p">blue widgets {i}</a>' for i in range(14))
    for t in ["cheap tickets best cheap tickets online cheap tickets Paris. " * 12, links, titled, "Tags: red, blue, green, red, blue, shoes, hats, red, shoes, blue, hats " * 3, "Home > Products > Shoes\nHome > Products > Hats\nHome > Contact > Map\n" * 4, " ".join(f"item{i} ({i * 7})" for i in range(60)), "SKU-1 red shoe M; SKU-2 red shoe L; SKU-3 red hat M; SKU-4 red hat L; " * 4, PROSE + "best cheap shoes online cheap shoes discount shoes " * 20]:
        assert spam(t), t[:60]
    for t in [None, "", "   ", "!!!", "Title only", PROSE, PROSE * 5, PROSE * 2 + CODE, CODE * 5, "12:20:16 WARN chunk_670 workers=3857\n12:39:34 DEBUG max_outboxes payloads=3601\n" * 20, PROSE * 8 + "Tags: red, blue, green, red, blue", "\n".join(f"- [Name{i}](https://x{i}.example/a): It is one of the pages that we keep for the team." for i in range(9)), "\n".join(f"| key_{i} | {i} | The value is read by all of the workers when they start. |" for i in range(9))]:
        assert not spam(t), (t or "")[:60]


def test_spam_table(spark):
    long = "cheap tickets best price " * 30000
    d = spark.createDataFrame([(1, PROSE, 1), (2, None, 1), (3, "", 1), (4, long, 1), (4, long, 1), (None, long, 1), (5, "cheap shoes " * 30, 1)], "doc_id long, text string, n_words int")
    assert {r.doc_id for r in sp.spam_pages(d).collect()} == {4, 5} and sp.spam_pages(d).count() == 2 and sp.spam_pages(d.limit(0)).count() == 0


def distance(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance_equals_dynamic_programming():
    rng = random.Random(8)
    for _ in range(300):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        t = [rng.randrange(5) for _ in range(rng.randrange(0, 60))]
        assert el.least_distance(p, t) == distance(p, t)


def test_every_passage_holds_more_pieces_than_it_may_have_edits():
    for n in range(1, 400):
        length = el.passage_length(n)
        e, p, at = el.error_budget(length), el.piece_length(length), el.pieces(n)
        assert p * (e + 1) <= length
        for s in range(n - length + 1):
            apart, end = 0, 0
            for x in at:
                if x >= max(s, end) and x + p <= s + length:
                    apart, end = apart + 1, x + p
            apart_back, start = 0, n
            for x in reversed(at):
                if s <= x and x + p <= min(s + length, start):
                    apart_back, start = apart_back + 1, x
            assert max(apart, apart_back) > e, (n, s)


def words(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.randrange(30)}x" for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(6)
    items = [(i, words(rng, 60)) for i in range(30)]
    shared = "Read the passage and answer with one word only please now."
    rows = [(i, f"{shared}\nPassage: {' '.join(w[:45])}.\nQuestion: {' '.join(w[45:])}?", "x") for i, w in items]
    d = spark.createDataFrame(rows + rows[:3] + [(None, "a b c d e f g h i j k l m n", ""), (90, None, ""), (91, "one two", "")], "item_id long, text string, doc_id string")

    def edited(w, every):
        out = []
        for k, x in enumerate(w):
            r = k % every
            out += [] if r == every - 1 and rng.random() < 0.3 else [x.upper() + "!"] if r != every - 1 else [rng.choice(["zzz", x + " extra"])]
        return " ".join(out)

    docs, want = [], set()
    noise = lambda n: " ".join(words(rng, n))
    for i, w in items:
        docs.append((10 * i, noise(80) + " " + " ".join(w) + " " + noise(50), 0))
        docs.append((10 * i + 1, noise(20) + "\n<b>" + edited(w[10:45], 8) + "</b>\n" + noise(200), 0))
        docs.append((10 * i + 2, noise(30) + " ".join(w[5:13]) + " " + noise(30), 0))  # a few words in a row
        docs.append((10 * i + 3, noise(30) + " " + " ".join(rng.sample(w, 60)) + noise(9), 0))  # another order
        docs.append((10 * i + 4, shared + " " + noise(60), 0))
        want |= {(10 * i, i), (10 * i + 1, i)}
    docs.append((5000, " ".join(x.replace("a", "а").replace("e", "е​") for x in items[0][1]), 0))
    docs.append((5001, noise(60000) + " " + " ".join(items[1][1][:30]), 0))
    want |= {(5000, 0), (5001, 1)}
    docs += [docs[0], (None, docs[0][1], 0), (6000, None, 0), (6001, "", 0)]
    pages = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(4)
    got = [tuple(r) for r in el.eval_leaks(pages, d).collect()]
    assert set(got) == want and len(got) == len(want)
    el.BLOCK_CHARS, keep = 900, el.BLOCK_CHARS
    try:
        assert len(list(el._blocks(el.item_words(d, "item_id", "text")))) > 3
        assert {tuple(r) for r in el.eval_leaks(pages, d).collect()} == want
    finally:
        el.BLOCK_CHARS = keep
    assert el.eval_leaks(pages.limit(0), d).count() == 0 and el.eval_leaks(pages, d.limit(0)).count() == 0

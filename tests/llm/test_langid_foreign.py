"""The pipeline's language stage lets the learned languages through and nothing else."""

import random

from quarry.llm import langid

FOREIGN = [
    "市议会星期二开会讨论了横跨河流的新桥。成员们在投票前讲了两个小时。工程将于春天开始。", "Городской совет собрался во вторник, чтобы обсудить новый мост через реку.",
    "O conselho reuniu-se na terça-feira para discutir a nova ponte sobre o rio. Os membros falaram durante duas horas antes de votarem.",
    "Kommunfullmäktige möttes på tisdagen för att diskutera den nya bron över floden. Ledamöterna talade i två timmar innan de röstade.",
    "Kaupunginvaltuusto kokoontui tiistaina keskustelemaan uudesta sillasta joen yli. Jäsenet puhuivat kaksi tuntia ennen äänestystä.",
    "Rada miasta zebrała się we wtorek, aby omówić nowy most na rzece. Członkowie mówili przez dwie godziny przed głosowaniem.",
    "Belediye meclisi salı günü nehir üzerindeki yeni köprüyü görüşmek üzere toplandı. Üyeler oylamadan önce iki saat konuştu.",
    "xqzv kjwpt bgfdk zzqxp wvkjh qpwlr mnbvx zxcvb lkjhg fdsqw rtypl qwzxc",
]


def test_foreign_texts_go_and_others_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r[0], r[1], r[2], 0.5) for r in docs.collect()]
    rng = random.Random(1)
    odd = [(10**6 + 4 * k, x, None, 0.5) for k, x in enumerate(FOREIGN)] + [(2 * 10**6, " ".join(rng.sample(FOREIGN[0], 20)), None, 0.5), (2 * 10**6 + 1, None, "en", 0.5), (2 * 10**6 + 2, "123 456", "en", 0.5)]
    all_ = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, familiarity double")  # a clashing name
    kept = langid.accepted(all_)
    assert kept.columns == all_.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert not ids & {r[0] for r in odd}
    assert len({r[0] for r in rows} - ids) <= len(rows) // 500


def test_one_language_alone(spark):
    docs = spark.createDataFrame([(k, "so it goes on and on", "en") for k in range(9)] + [(99, "", "en")], "doc_id long, text string, lang string")
    assert langid.accepted(docs).count() == 9
    assert langid.accepted(docs.limit(0)).count() == 0

import base64
import quopri

import pytest

from pagewright.llm import seeds
from pagewright.llm.mail import sentences, text_parts
from pagewright.llm.moderation import THRESHOLD, fit, moderate, rates, stretches, terms_of, train, words_of

HEAD = "Subject: x\nContent-Type: text/plain; charset=utf-8\n"


@pytest.fixture(scope="module")
def machine():
    return train([])


def score(machine, text):
    return max(machine.scores([terms_of(w) for w in stretches(words_of(text))]), default=0.0)


def test_held_out_seeds():
    every = seeds.labelled()
    kept = [(terms_of(words_of(s)), y, 1.0) for i, (s, y) in enumerate(every) if i % 5]
    machine = fit(kept)
    held = [(s, y) for i, (s, y) in enumerate(every) if i % 5 == 0]
    right = sum((score(machine, s) >= 0.5) == bool(y) for s, y in held)
    assert right / len(held) > 0.85


@pytest.mark.parametrize("text", ["You are a useless idiot", "YOU USELESS M0R0N", "you are a stupid b*tch", "you useless m o r o n", "you worthless biiiitch", "immigrants are vermin and must be deported", "send me a nude picture tonight", "y\u200bou useless іdiot", "you f" + "u" * 30 + "cking idiot"])
def test_found(machine, text):
    assert score(machine, text) >= THRESHOLD


@pytest.mark.parametrize("text", ["", "Rats were found behind the shelf, pest control comes on Friday.", "Immigrants are welcome at the course.", "Remember to kill the child process.", "Please find the report attached.", "The cockpit of the plane needs a new screw."])
def test_harmless(machine, text):
    assert score(machine, text) < THRESHOLD


#: Written by hand, on topics that the seeds don't speak of.
OTHER_BAD = """Your cooking is as rotten as you are, you fat pig.
Only an imbecile like you would plant roses in the shade, you stupid cow.
You pathetic excuse for a goalkeeper, go and die.
I will smash your violin and then your head, bastard.
Somebody should shoot you before you sing again.
What a dumb whore the new librarian is.
Shut your mouth, you ugly bastard, nobody asked about your garden.
You filthy liar, I hope you get cancer before the regatta.
All gypsies are thieves and parasites.
Muslims are savages and don't deserve rights on our beaches.
We don't want blacks in our chess club.
Refugees are cockroaches, deport all of them.
Women are stupid by nature and ruin every orchestra.
I want to lick your pussy in the greenhouse.
Show me your tits on the ferry.
She spread her legs on the piano and he came all over her.
Fuck me hard behind the stables.
Watch horny teens get fucked in the sauna.
Du dreckiges Arschloch hast mein Fahrrad gestohlen.
Ich bringe dich um, du Schwein.
Espèce de crétin, ton jardin est une ordure comme toi.
Eres un estúpido cerdo y tu barco también.
Ты тупой урод, и собака твоя такая же.
お前はただのゴミだ、消えろ""".split("\n")
OTHER_GOOD = """Roses should not be planted in the shade.
The goalkeeper saved a penalty in the last minute.
The violin was smashed when the shelf fell.
The new librarian speaks four languages.
Thieves stole the painting from the chapel.
The regatta was won by the youngest crew.
Our chess club has members from twelve countries.
The beach was closed because of sharks.
Cockroaches can live a week without water.
The orchestra hired three women for the brass section.
The greenhouse needs a new heater.
The ferry leaves at nine and the sauna opens at ten.
A cat licked the milk from the saucer.
He came all the way from Porto to hear the piano.
The horse kicked hard against the stable door.
The pig weighed three hundred kilos at the fair.
The hunter shot two ducks at dawn.
The stupid lock froze again last night.
Das Fahrrad steht im Keller neben den Schweinen.
Der Hund hat das Arzneimittel gut vertragen.
Le jardin du voisin est plein de roses.
El barco sale a las ocho del puerto.
Собака спит у двери.
ゴミの分別を覚えました""".split("\n")


def test_other_topics(machine):
    """Recall and precision of the seeds alone on sentences of other topics; the README gives the figures."""
    hit = [score(machine, s) >= THRESHOLD for s in OTHER_BAD]
    false = [score(machine, s) >= THRESHOLD for s in OTHER_GOOD]
    print("other topics: recall", sum(hit) / len(hit), "precision", sum(hit) / (sum(hit) + sum(false)), [s for s, h in zip(OTHER_BAD, hit) if not h], [s for s, h in zip(OTHER_GOOD, false) if h])
    assert sum(hit) / len(hit) >= 0.7 and sum(hit) / (sum(hit) + sum(false)) >= 0.85


def test_deep_nesting_is_read_to_the_end():
    message = "inside"
    for i in range(60):
        message = f'Content-Type: multipart/mixed; boundary="b{i}"\n\n--b{i}\n{message if i else "Content-Type: text/plain" + chr(10) * 2 + message}\n--b{i}--\n'
    assert [t.strip() for t in text_parts(message) if t.strip()] == ["inside"]


def test_labels_teach(machine):
    """A turn of phrase that the seeds don't know, in enough labelled documents, is found in others; a harmless one isn't."""
    bad = [(HEAD + f"\nThe stock is low.\n\nMay your {x} sink with you aboard, landlubber of the lowest sort.", 1) for x in "boat raft canoe yacht ship barge".split()]
    good = [(HEAD + f"\nThe stock is low.\n\nThe {x} lies in the harbour with two men aboard this week.", 0) for x in "boat raft canoe yacht ship barge ferry tug lugger skiff dinghy punt".split()]
    taught = train(bad + good * 2)
    assert score(taught, "May your tanker sink with you aboard, landlubber of the lowest sort.") >= THRESHOLD > score(machine, "May your tanker sink with you aboard, landlubber of the lowest sort.")
    assert score(taught, "The tanker lies in the harbour with two men aboard this week.") < THRESHOLD and score(taught, "The stock is low.") < THRESHOLD


def test_pairs_weigh_more_than_their_sum():
    """Two terms that are bad only together: a linear model can't tell them."""
    machine = fit([([1, 2], 1, 1.0), ([1, 3], 0, 1.0), ([4, 2], 0, 1.0), ([4, 3], 1, 1.0)] * 5, epochs=400)
    assert [round(float(s)) for s in machine.scores([[1, 2], [1, 3], [4, 2], [4, 3]])] == [1, 0, 0, 1]


def test_mail_parts():
    body = "Größe eins.\n\nZwei."
    assert text_parts(HEAD + "\n" + body) == [body]
    assert text_parts(HEAD + "Content-Transfer-Encoding: base64\n\n" + base64.encodebytes(body.encode()).decode()) == [body]
    assert text_parts("From me\n" + HEAD.replace("\n", "\r\n") + "Content-Transfer-Encoding: quoted-printable\r\n\r\n" + quopri.encodestring(body.encode()).decode()) == [body]
    multi = 'Content-Type: multipart/mixed;\n boundary="b"\n\nintro\n--b\nContent-Type: text/html\n\n<style>x</style><p>a<b>b</b></p><p>c&amp;d\n--b\nContent-Type: image/png\n\nxyz\n--b\n\nplain'
    assert [" ".join(t.split()) for t in text_parts(multi)] == ["ab c&d", "plain"]
    assert text_parts(None) == [] and text_parts("") == [] and text_parts("no headers here") == ["no headers here"]
    assert text_parts('Content-Type: multipart/mixed; boundary="b"\n\ncut') == ["cut"]
    assert sentences("> > One line\n> goes on. Two!\n\n--\nx") == ["One line goes on.", "Two!", "-- x"]


def test_frame(spark):
    rows = [(1, "a", HEAD + "\nYou are a useless idiot.", 0), (2, "a", HEAD + "\nPlease find the report attached.", 0), (3, None, None, 0), (4, "b", "", 0), (4, "b", "", 0), (5, "b", "x" * 100_000 + " you useless idiot " + "y " * 1000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, score int")
    labels = spark.createDataFrame([(1, "r", "abusive"), (2, "r", "clean"), (2, "s", None), (9, "r", "clean")], "doc_id long, reviewer string, label string")
    got = moderate(df, labels)
    assert {r.doc_id for r in got.where("flagged").collect()} == {1, 5} and got.count() == 6
    by = {r.source: r for r in rates(got).collect()}
    assert by["a"].rate == 0.5 and by["b"].documents == 3 and by[None].flagged == 0
    assert moderate(df.limit(0), labels.limit(0)).count() == 0

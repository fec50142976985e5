"""Labelled findings that the secret scan learns from by default.

Each example is a place in which a value stands, labelled by hand: 1 a credential, 0 anything else.  Places
are written out; values are of a kind and drawn by a seeded rule, so that shapes are learnt and not
strings.  ``rows`` gives (value, left, right, label, example)."""

from __future__ import annotations

import base64
import random
import string

# words that values and neighbouring texts are made of
WORDS = ("account active admin alpha backup basic beta blue branch bridge cloud config current daily data default demo "
         "deploy disabled empty enabled example field file filter final first forest garden global green group hidden "
         "house index input internal island item latest letter local login main manual market master member memory "
         "metric model module monkey morning name network normal number office option orange order output owner "
         "parser party pattern people person planet plain primary private process profile project public queue random "
         "record region remote report required river sample schema second server service session setting shadow signal "
         "silver simple single source spring stage standard start status string summer support system table target "
         "team temporary test text theme third tiger title token tree type unknown user value version view water "
         "winter window wizard world yellow zone").split()

# (label, text before, kind of value or "=" and the value, text after)
EXAMPLES = [
    (1, "password=", "mixed", ""), (1, "password = '", "mixed", "'"), (1, "\"password\": \"", "mixed", "\","),
    (1, "\"password\": \"", "word", "\"}"), (1, "pwd='", "word", "'"), (1, "passwd: '", "wordnum", "'"), (1, "DB_PASSWORD=", "wordnum", "\nDB_HOST=db"),
    (1, "db.password = ", "mixed", "\n"), (1, "passphrase: \"", "phrase", "\""), (1, "my password: ", "mixed", " and then"),
    (1, "login with password ", "=x", ""), (1, "set PGPASSWORD=", "wordnum", " psql"), (1, "mysql --password=", "mixed", " -u root"),
    (1, "pwd: ", "symbols", ""), (1, "password := \"", "symbols", "\""), (1, "password => '", "symbols", "',"),
    (1, "api_key: ", "short", "."), (1, "api_key = \"", "alnum32", "\""), (1, "apiKey: '", "alnum24", "',"), (1, "API-KEY=", "hex32", "&v=1"),
    (1, "x-api-key: ", "alnum40", "\n"), (1, "\"apikey\":\"", "alnum20", "\""), (1, "access_key=", "upper20", "\n"), (1, "ACCESS_KEY_ID and SECRET_ACCESS_KEY=", "b64x40", " region"),
    (1, "export AWS_SECRET_ACCESS_KEY=", "b64x40", " next"), (1, "aws_secret_key = ", "b64x40", ""), (1, "private_key: \"", "b64x64", "\""),
    (1, "client_secret=", "alnum32", "&grant_type=code"), (1, "clientSecret: '", "urlsafe40", "'"), (1, "secret: ", "hex40", "\n"),
    (1, "secret = \"", "hex64", "\""), (1, "SECRET_KEY='", "symbols", "'"), (1, "secret=", "padded24", " end"), (1, "secret: ", "urlsafe24", ""),
    (1, "token = \"", "hex40", "\""), (1, "token=", "hex16", "&page=2"), (1, "?token=", "alnum16", "&next=1"), (1, "&access_token=", "urlsafe40", " HTTP/1.1"),
    (1, "auth_token: ", "hex40", ""), (1, "authToken=\"", "alnum24", "\""), (1, "refresh_token: \"", "urlsafe64", "\""), (1, "a token: ", "alnum32", " was sent"),
    (1, "the token is token = \"", "hex32", "\" for now"), (1, "Authorization: Bearer ", "dotted", " now"), (1, "authorization: bearer ", "urlsafe40", ""),
    (1, "-H 'Authorization: Bearer ", "hex40", "'"), (1, "Authorization: Basic ", "padded20", " now"), (1, "Proxy-Authorization: Basic ", "padded28", ""),
    (1, "Authorization: token ", "=x", ""), (1, "postgres://joe:", "mixed", "@host/db"), (1, "see mysql://admin:", "symbols", "@10.0.0.3:3306"),
    (1, "https://ci:", "alnum20", "@git.example.com/a.git"), (1, "amqp://user:", "wordnum", "@queue"), (1, "redis://:", "alnum16", "@cache:6379"),
    (1, "passphrase = '", "phrase", "'"), (1, "\"passphrase\": \"", "phrase", "\""), (1, "passphrase=", "phrase", "\n"), (1, "\"password\": \"", "phrase", "\""),
    (1, "password = \"", "word", "\""), (1, "\"pwd\":\"", "word", "\"}"), (1, "'password' => '", "word", "'"), (1, "password=\"", "wordnum", "\""),
    (1, "pwd = '", "lowsym", "'"), (1, "password: \"", "lowsym", "\""), (1, "PASSWORD=", "lowsym", "\n"), (1, "secret = '", "lowsym", "'"), (1, "ftp://web:", "lowsym", "@files"),
    (1, "Authorization: Bearer ", "dotted", ""), (1, "bearer ", "dotted", " end"), (1, "with Bearer ", "alnum40", " sent"), (1, "Bearer ", "jwt", "\""),
    (1, "the key ", "akia", " is old"), (1, "", "akia", ""), (1, "use ", "ghp", "."), (1, "found ", "glpat", " in the log"), (1, "hook ", "xoxb", ""),
    (1, "with ", "sklive", "\n"), (1, "cookie: session=", "jwt", ";"), (1, "id_token ", "jwt", " of the user"), (1, "key ", "npm", ""), (1, "maps ", "aiza", "&q=x"),
    (0, "commit ", "hex40", " done"), (0, "commit: ", "hex40", "\n"), (0, "(", "hex40", ")"), (0, "merge ", "hex32", " into main"), (0, "tree/", "hex40", "/docs"),
    (0, "sha256=", "hex64", ""), (0, "sha256:", "hex64", "\n"), (0, "md5 ", "hex32", "  file.txt"), (0, "checksum: ", "hex40", ""), (0, "digest=\"", "padded44", "\""),
    (0, "etag: \"", "hex32", "\""), (0, "sha512-", "padded88", "\""), (0, "integrity=\"", "padded64", "\""), (0, "hash = '", "hex64", "'"),
    (0, "id: ", "uuid", ""), (0, "uuid=", "uuid", "&x=1"), (0, "/items/", "uuid", "/edit"), (0, "request ", "uuid", " failed"), (0, "trace_id=", "hex32", " span"),
    (0, "x=", "num20", ""), (0, "order ", "num16", " shipped"), (0, "isbn ", "num13d", ""), (0, "id=", "num18", "&"), (0, "phone ", "num16", ""), (0, "card ", "num16", ""),
    (0, "at ", "stamp", " the job"), (0, "file_", "stamp", ".log"), (0, "version ", "verlong", ""), (0, "build ", "verlong", "\n"),
    (0, "see /usr/lib/", "path", "/main.py"), (0, "open ", "path", " again"), (0, "https://www.example.com/", "path", "?a=1"), (0, "C:/", "path", ""), (0, "import ", "path", "\n"),
    (0, "def ", "ident", "(self)"), (0, "call ", "ident", " twice"), (0, "the ", "camel", " class"), (0, "#", "ident", " { color"), (0, "const ", "camel", " = 3"),
    (0, "name=", "ident", "&"), (0, "key: ", "ident", ""), (0, "see ", "slug", " for more"), (0, "/blog/", "slug", ".html"), (0, "branch ", "slug", ""),
    (0, "password: ", "word", " here"), (0, "password = ", "word", " in the form"), (0, "the password: ", "word", " or not"), (0, "token: ", "word", " of the text"),
    (0, "token = ", "=null", ""), (0, "token=", "=None", ","), (0, "password = ", "=true", ""), (0, "secret: ", "=false", "\n"), (0, "token: ", "=undefined", ""),
    (0, "\"password\": \"", "=string", "\""), (0, "password: ", "=required", ""), (0, "secret = ", "=optional", " value"), (0, "auth: ", "=basic", "\n"),
    (0, "auth: ", "word", "\n"), (0, "auth = ", "=oauth2", ""), (0, "authorization: ", "word", " needed"), (0, "credentials: ", "=include", ","), (0, "credentials: '", "=same-origin", "'"),
    (0, "api_key=", "=YOUR_API_KEY", "&q=1"), (0, "api_key = \"", "=YOUR_API_KEY_HERE", "\""), (0, "token: ", "=YOUR_TOKEN", ""), (0, "password=", "=yourpassword", ""),
    (0, "secret: '", "=insert-secret-here", "'"), (0, "password: ", "=changeme", ""), (0, "password = \"", "=change_me", "\""), (0, "password: ", "stars", ""), (0, "pwd=", "stars", "&"),
    (0, "token=", "xs", ""), (0, "api_key: \"", "xs", "\""), (0, "secret = \"", "=example-secret", "\""), (0, "token = '", "=sample_token", "'"), (0, "password: '", "=placeholder", "'"),
    (0, "password = ", "=$PASSWORD", ""), (0, "token: ", "=$GITHUB_TOKEN", ""), (0, "secret=", "=%SECRET%", ""), (0, "password = ", "=config.password", "\n"),
    (0, "token = ", "=self.token", "\n"), (0, "token = ", "=response.data.token", ";"), (0, "secret = ", "=os.environ", "["), (0, "password: ", "=process.env.DB_PASSWORD", ","),
    (0, "token: ", "num4", ""), (0, "token=", "num4", "&"), (0, "token ", "num16", ""), (0, "secret: ", "num4", " items"), (0, "password: ", "=8-64", " characters"),
    (0, "auth: ", "date", ""), (0, "authorization: ", "date", ""), (0, "token: ", "date", " expired"), (0, "authorization: ", "personname", ""), (0, "credential: ", "personname", "\n"),
    (0, "auth: ", "host", "\n"), (0, "token: ", "host", ""), (0, "secret: ", "filename", ""), (0, "private_key: ", "filename", "\n"), (0, "private_key=", "path", ""),
    (0, "wine=", "yearword", ""), (0, "style: ", "yearword", ""), (0, "theme=", "yearword", "&"), (0, "label: \"", "yearword", "\""), (0, "release ", "yearword", " is out"),
    (0, "access_key: ", "word", " to enter"), (0, "token: ", "camel", ";"), (0, "pwd: ", "path", ""), (0, "http://localhost:", "=8080", "@x"), (0, "data:image/png;base64,", "b64x64", "\""),
    (0, "the basic ", "word", ""), (0, "bearer ", "=of-good-news", " came"), (0, "mailto:", "=list-unsubscribe-12", "@mail"), (0, "nonce-", "padded24", "'"), (0, "csrf form ", "ident", " field"),
]
# keys of well-known formats are credentials wherever they stand
EXAMPLES += [(1, left, kind, right) for kind in ("akia", "ghp", "glpat", "xoxb", "sklive", "jwt", "npm", "aiza", "plainkey", "orderedkey")
             for left, right in (("use ", "."), ("", " was there"), ("found: ", "\n"))]


def _value(kind: str, r: random.Random) -> str:
    def some(alphabet: str, n: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(n))
    word, low, num = (lambda: r.choice(WORDS)), string.ascii_lowercase, string.digits
    base = kind.rstrip("0123456789")
    n = int(kind[len(base):] or 0)
    both = string.ascii_letters + num
    if kind.startswith("="):
        return kind[1:]
    if base == "hex":
        return some("0123456789abcdef", n)
    if base == "alnum":
        return some(both, n)
    if base == "upper":
        return some(string.ascii_uppercase + num, n)
    if base == "b64x":
        return some(both + "+/", n)
    if base == "urlsafe":
        return some(both + "-_", n)
    if base == "padded":
        return base64.b64encode(r.randbytes(n * 3 // 4 - 1)).decode()
    if base == "num":
        return str(r.randint(10 ** (n - 1), 10 ** n - 1))
    if kind == "num13d":
        return f"978-{r.randint(0, 9)}-{some(num, 5)}-{some(num, 3)}-{some(num, 1)}-{some(num, 4)}"
    return {
        "word": lambda: word() if r.random() < 0.7 else word() + r.choice(("s", "ed", "er")),
        "wordnum": lambda: word() + some(num, r.randint(1, 4)),
        "yearword": lambda: f"{word().capitalize()}{r.randint(1950, 2030)}{word()}{word() if r.random() < 0.5 else ''}",
        "phrase": lambda: "-".join(word() for _ in range(4)),
        "mixed": lambda: word().capitalize() + some(num, r.randint(1, 4)) + some(both + "!#%*_-", r.randint(2, 10)),
        "symbols": lambda: some(both, r.randint(2, 5)) + r.choice("!@#%^*.") + some(both + "!#%^*.", r.randint(3, 14)) + some(low, 1) + "!",
        "lowsym": lambda: some(low, r.randint(1, 3)) + "".join(r.choice("@.:!#%*-") + some(low, r.randint(1, 3)) for _ in range(r.randint(2, 4))) + r.choice("!#*"),
        "plainkey": lambda: r.choice(("AKIA", "ASIA")) + some(string.ascii_uppercase, 16) if r.random() < 0.5 else r.choice(("ghp_", "npm_")) + some(string.ascii_letters, 36),
        "orderedkey": lambda: "AKIA" + ("".join(string.ascii_uppercase) * 2)[r.randint(0, 25):][:16] if r.random() < 0.5 else "ghp_" + ((low + num) * 2)[r.randint(0, 35):][:36],
        "short": lambda: some(num, 2) + some(low, 2) + r.choice("!#%") + some(low, 2),
        "dotted": lambda: f"{some(low, 3)}.{some(both, 5)}-{some(num, 3)}_{some(low, 4)}~{some(both, 4)}",
        "uuid": lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        "akia": lambda: "AKIA" + some(string.ascii_uppercase + num, 16), "ghp": lambda: "ghp_" + some(both, 36),
        "glpat": lambda: "glpat-" + some(both + "_-", 20), "npm": lambda: "npm_" + some(both, 36), "aiza": lambda: "AIza" + some(both + "_-", 35),
        "xoxb": lambda: f"xoxb-{some(num, 11)}-{some(both, 24)}", "sklive": lambda: "sk_live_" + some(both, 24),
        "jwt": lambda: f"eyJ{some(both, 17)}.eyJ{some(both, 30)}.{some(both + '_-', 43)}",
        "stamp": lambda: f"20{some(num, 2)}0{r.randint(1, 9)}{r.randint(10, 28)}T{some(num, 6)}.{some(num, 3)}Z", "date": lambda: f"20{some(num, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}",
        "verlong": lambda: f"{r.randint(1, 20)}-{r.randint(0, 30)}-{r.randint(0, 9)}-rc{r.randint(1, 9)}-linux-x86_64", "stars": lambda: "*" * r.randint(4, 16),
        "xs": lambda: "x" * r.randint(4, 32), "path": lambda: "/".join(word() + (some(num, 1) if r.random() < 0.4 else "") for _ in range(r.randint(3, 6))) + some(num, 1),
        "ident": lambda: "_".join(word() for _ in range(r.randint(3, 5))) + "_" + some(num, r.randint(1, 2)), "slug": lambda: "-".join(word() for _ in range(r.randint(3, 6))) + "-" + some(num, r.randint(1, 4)),
        "camel": lambda: word() + "".join(word().capitalize() for _ in range(r.randint(2, 4))) + some(num, 1),
        "personname": lambda: f"{word().capitalize()}.{word().capitalize()}", "host": lambda: f"www.{word()}.example.org",
        "filename": lambda: f"{word()}_{word()}.{r.choice(('pem', 'txt', 'json', 'yml'))}",
    }[kind]()


def rows(values: int = 12) -> list[tuple[str, str, str, int, int]]:
    """(value, left, right, label, example): ``values`` values of each example (one if it is written out)."""
    out = []
    for k, (label, left, kind, right) in enumerate(EXAMPLES):
        r = random.Random(1000 + k)
        if kind == "=x":  # a place without separator holds a value of the common kinds
            kind = "alnum24"
        for _ in range(3 if kind.startswith("=") else values):
            lead = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 6)))
            tail = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 3)))
            out.append((_value(kind, r), f"{lead} {left}" if lead and r.random() < 0.7 else left, f"{right} {tail}" if right[:1] != "" else right, label, k))
    return out

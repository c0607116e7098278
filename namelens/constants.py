"""Lists, thresholds and weights that results depend on."""

# --- fixed values: public suffixes of more than one label ---
MULTI_LABEL_SUFFIXES = tuple("""
co.in net.in org.in gen.in firm.in ind.in ac.in edu.in res.in gov.in mil.in nic.in bank.in ernet.in
co.uk org.uk me.uk com.au net.au org.au co.nz com.br com.cn com.sg com.my com.ph co.id co.za com.pk com.bd com.np com.lk co.ke com.ng
github.io gitlab.io pages.dev workers.dev web.app firebaseapp.com netlify.app vercel.app blogspot.com wixsite.com weebly.com
myshopify.com r2.dev onrender.com glitch.me repl.co surge.sh herokuapp.com azurewebsites.net s3.amazonaws.com duckdns.org ddns.net
hopto.org zapto.org serveo.net ngrok.io ngrok-free.app trycloudflare.com
""".split())

# --- fixed values: suffixes known to the derivation of match terms ---
SEED_SUFFIXES = tuple("co.in net.in org.in gen.in firm.in ind.in ac.in edu.in res.in gov.in mil.in nic.in bank.in co.uk com.au co.za".split())

# --- fixed values: platforms whose names are never evaluated ---
IGNORED_SUFFIXES = tuple("""
amazonaws.com cloudfront.net azurewebsites.net herokuapp.com github.io gitlab.io netlify.app vercel.app pages.dev workers.dev
firebaseapp.com web.app appspot.com blogspot.com wordpress.com wixsite.com weebly.com shopify.com myshopify.com sharepoint.com
salesforce.com force.com zendesk.com freshdesk.com atlassian.net notion.site googleusercontent.com akamaized.net fastly.net
cloudflare.net sendgrid.net cpanel.net plesk.page
""".split())

# --- fixed values: words of credential harvesting ---
KEYWORDS = tuple("""
login signin secure security verify verification update account kyc netbanking onlinebanking banking otp auth authenticate confirm
validate reward refund cashback offer bonus wallet recharge payment pay upi block unblock suspend reactivate reactivation alert
support helpdesk customercare care apply form gov portal
""".split())

# --- fixed values: terms that match whole tokens only; probes that a fuzzy match never lands on ---
TOKEN_ONLY_TERMS = tuple("kotak uidai incometax airtel rupay phonepe".split())
STOP_PROBES = tuple("phone mobile canary".split())

# --- fixed values: marks of a parked page, and words of a credential form ---
PARKING_MARKERS = (
    "domain is for sale", "buy this domain", "this domain is parked", "parked free, courtesy", "domain parking", "godaddy.com/domainsearch",
    "sedoparking", "parkingcrew", "bodis.com", "afternic", "dan.com", "hugedomains", "namecheap parking",
    "future home of something quite cool", "default web page", "apache2 ubuntu default page", "welcome to nginx", "iis windows server",
    "site not configured", "coming soon", "under construction", "account suspended", "this site can’t be reached",
)
CREDENTIAL_MARKERS = (
    "password", "passcode", "pin", "mpin", "user id", "userid", "customer id", "login", "log in", "sign in", "netbanking", "net banking",
    "internet banking", "otp", "one time password", "cvv", "card number", "aadhaar", "aadhar", "upi pin", "debit card", "credit card",
    "account number",
)

# --- fixed values: patterns of forms and titles, the entities of a title, and the points of a page (parked: the most that a parked one has) ---
PASSWORD = r"""(?i)<input[^>]+type\s*=\s*["']?password["']?"""
PASSWORDISH = r"""(?i)<input[^>]+(?:name|id)\s*=\s*["']?[^"'>]*(?:pass|pwd|pin|mpin|otp|cvv)[^"'>]*["']?"""
FORM_ACTION = r"""(?i)<form[^>]+action\s*=\s*["']([^"']+)["']"""
TITLE = r"(?is)<title[^>]*>(.{0,300}?)</title>"
#: In this order, so that an escaped entity is decoded twice.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
PAGE_POINTS = {"password": 40, "brand": 25, "both": 20, "offsite": 10, "words": 5, "parked": 10}

# --- fixed values: parts of the names of issuers without charge ---
FREE_ISSUERS = ("let's encrypt", "zerossl", "google trust services", "buypass", "actalis", "ssl.com", "cloudflare inc ecc ca")

# --- fixed values: bounds of matching ---
MAX_LABEL = 63
MAX_DISTANCE = 2
FUZZY_LENGTH = 6
SUBSTRING_LENGTH = 5
TERM_LENGTH = 3
KIND_RANK = {"substring": 1, "keyword_combo": 2, "edit_distance": 3, "homoglyph": 4, "exact_token": 5}

# --- fixed values: weights of signals, by key ---
WEIGHTS_VERSION = "v1"
WEIGHTS = {
    "name.homoglyphNonAscii": 28, "name.exactToken": 18, "name.editDistance1": 12, "name.editDistance2": 8, "name.substring": 8,
    "name.phishingKeyword": 10, "name.mixedScript": 6, "infrastructure.resolves": 20, "infrastructure.hasMx": 6,
    "registration.ageUnder3Days": 14, "registration.ageUnder7Days": 12, "registration.ageUnder30Days": 8, "registration.ageUnder90Days": 4,
    "registration.ageOver1Year": -18, "content.passwordField": 22, "content.brandOnPage": 12, "content.passwordAndBrand": 12,
    "content.formPostsOffsite": 6, "content.looksParked": -15, "certificate.certSameDayAsRegistration": 8, "certificate.certWithin3Days": 4,
    "certificate.freeDvIssuer": 4, "hosting.knownAbusedAsn": 0,
}
MITIGATING = ("registration.ageOver1Year", "content.looksParked")
STRONG_SIGNALS = ("content.passwordField", "name.homoglyphNonAscii")
TIER_HIGH, TIER_MEDIUM = 70, 45
MIN_CATEGORIES = 2

# --- fixed values: hours between rechecks, and rechecks without an address before a candidate retires ---
RECHECK_HOURS = {"new": 1, "active": 6, "quiet": 48, "dormant": 24}
RETIRE_AFTER = 14
#: Characters of the reason that clearing a candidate needs.
REASON_LENGTH = 3
PAGE_SIZE, MAX_PAGE_SIZE, MAX_OFFSET = 50, 200, 10_000

# --- fixed values: characters that look like an ASCII one, by that one; those that NFKC turns into ASCII can't occur any more, and accented letters that lose their marks give the same; both are left out ---
LOOKALIKES = {
    "a": "аАәӓαΑᾳ", "b": "вВЬьЪΒβƅɓ", "c": "сСϲᴄϹ", "d": "ԁԀđðⅾ", "e": "еЕёЁєЄэԑѐΕεέ", "f": "ғƒ", "g": "ԍɡցǥ", "h": "һҺнНΗհħ",
    "i": "іІїЇӏӀıΙιίⅰ", "j": "јЈ", "k": "кКⱪΚκƙ", "l": "ⅼłǀ", "m": "мМΜⅿ", "n": "пИиηΝոպ", "o": "оОөӨӧᴏΟοόσΘθօøơ", "p": "рРΡρքƥ",
    "q": "ԛԚ", "r": "гГʀ", "s": "ѕЅսſ", "t": "тТᴛΤτŧ", "u": "цᴜυύư", "v": "ѵѴνᴠ", "w": "ԝԜшΩωա", "x": "хХΧχⅹ", "y": "уУүҮұΥγ",
    "z": "ᴢΖ", "-": "‐‑‒–—―ー",
}
DIGIT_SWAPS = {"0": "o", "1": "l", "3": "e", "5": "s", "4": "a", "7": "t"}
#: First code points of the scripts whose decimal digits are read as ASCII ones.
DIGIT_ZEROS = (0x0966, 0x09E6)
SCRIPTS = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A)), "Digit": ((0x30, 0x39),), "Cyrillic": ((0x0400, 0x04FF),), "Greek": ((0x0370, 0x03FF),),
    "Armenian": ((0x0530, 0x058F),), "Hebrew": ((0x0590, 0x05FF),), "Arabic": ((0x0600, 0x06FF),), "Devanagari": ((0x0900, 0x097F),),
    "Bengali": ((0x0980, 0x09FF),), "Han": ((0x4E00, 0x9FFF),), "Fullwidth": ((0xFF00, 0xFFEF),),
}

# --- fixed values: what signals say to a reader; {} is filled in by operators.scoring ---
LABELS = {
    "name.homoglyphNonAscii": "Uses look-alike characters from another alphabet",
    "name.exactToken": 'Contains the exact brand name "{}"',
    "name.exactToken/keyword_combo": 'Contains the brand name "{}"',
    "name.editDistance1": '{} character change away from "{}"',
    "name.editDistance2": '{} character changes away from "{}"',
    "name.substring": 'Contains "{}" inside a longer word',
    "name.phishingKeyword": "Combined with words used in credential-theft pages",
    "name.mixedScript": "Mixes characters from more than one alphabet",
    "infrastructure.resolves": "The domain is live and resolves to a server",
    "infrastructure.hasMx": "Configured to send and receive email",
    "registration.young": "Registered {} day{} ago",
    "registration.ageOver1Year": "Registered over {} year{} ago, which is unusual for phishing infrastructure",
    "content.passwordField": "The page asks visitors for a password or PIN",
    "content.brandOnPage": "The page uses the brand's name ({})",
    "content.passwordAndBrand": "It both impersonates the brand and asks for credentials",
    "content.formPostsOffsite": "A form on the page sends what you type to a different website",
    "content.looksParked": "The page is parked or for sale rather than a working site",
    "certificate.certSameDayAsRegistration": "A TLS certificate was issued the same day the domain was registered",
    "certificate.certWithin3Days": "A TLS certificate was issued {} day{} after registration",
    "certificate.freeDvIssuer": "The certificate came from a free, fully automated issuer",
    "hosting.knownAbusedAsn": "Hosted on a network with a history of abuse",
}
GATE_NOTES = {
    "dead": "Held below high confidence: the domain does not currently resolve, so nobody can be reaching it yet.",
    "few": "Held below high confidence: only {} independent kind{} of evidence ({}). High confidence needs at least {}.",
    "weak": "Held below high confidence: nothing here is conclusive on its own. Queued for human review.",
}

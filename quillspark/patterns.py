"""The patterns by which documents are read. Results depend on them as they stand, so they are stated here, together and unaltered."""

from __future__ import annotations

from . import vocab

# Contact data, bullets and dates.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\(?\s*\+?\s*\(?[0-9][0-9\s().\-]{7,}[0-9]\)?"
BULLETS = "•●▪‣⁃�–—➢➤➣❖▶▷-"
BULLET = rf"^[ \t]*[{BULLETS}]\s*"
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?"
DATE_PART = rf"(?:{MONTH}\s+|[0-9]{{1,2}}/)?[0-9]{{4}}(?:-[0-9]{{2}})?"
YEAR_RANGE = rf"(?i)({DATE_PART})\)?\s*(?:[-–—]|\bto\b|\btill\b)\s*({DATE_PART}|[0-9]{{2}}|present(?:\s+time)?|current(?:\s+date)?|onwards?|date)?(?:\s*,\s*concurrent(?:ly)?)?"
DATE_ONLY = r"(?i)^[\s|,()\-–—]*[0-9]{4}(?:-[0-9]{2})?\s*(?:[-–—]\s*(?:[0-9]{4}(?:-[0-9]{2})?|[0-9]{2}|present|current|onwards?))?[\s|,()\-–—.]*$"
DATE_ANCHOR = r"^[ \t]*(?:[0-9]{4}|[A-Za-z]{3,9}['’]?[0-9]{2,4})\s*[-–—]"
ENTRY_END_YEAR = r"(?i)(?<![0-9])(?:[0-9]{4}|[0-9]{2})\s*(?:[-–—]\s*(?:[0-9]{4}|[0-9]{2}|present|current|onwards))?\s*\)?\s*$"
PRESENT = r"(?i)\b(?:onwards?|present|current(?:ly)?|(?:to|till)\s+date)\b"
OPEN_LEAD = r"(?i)^(?:(?:to|till)\s+date|present(?:\s+time)?|current(?:ly)?|onwards?)\b"
SENTENCE_END = r"[.!?]\s*$"
OPEN_ENDS = ["present", "present time", "current", "current date", "onward", "onwards", "date"]
TRAILING_MONTH = r"(?i)[\s,]*(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s*$"
CALENDAR_YEAR = r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"
YEAR = r"\b(19[0-9]{2}|20[0-4][0-9])\b"

# Titles, organisations, names.
TITLE_WORD = r"(?i)\b(?:" + "|".join(vocab.TITLE_WORDS) + r")\b"
ORG_WORD = "(?i)" + "|".join(vocab.ORG_WORDS)
NAME_TOKEN = r"\p{L}+(?:['\-]\p{L}+)*\.?"
NAME_LINE = rf"^{NAME_TOKEN}(?:\s+{NAME_TOKEN}){{1,2}}$"
HONORIFIC = r"(?i)^(?:DR|PROF|PROFESSOR|MR|MRS|MS|MISS|SIR|DAME)\.?\s+"

# Lines that are never content.
VENDOR = (
    r"(?i)\bdear job seeker\b"
    r"|\bresume writ(?:er|ing) (?:service|from)\b"
    r"|\bcertified professional resume writer"
    r"|\bhire one of our\b"
    r"|\bstruggling to write your (?:resume|cv)\b"
    r"|\byou'?re in good company\b"
    r"|\bper resume\b"
    r"|\bresumethatworks\b|\bmoney-zine\b|\bresume\.io\b|\bzety\.com\b"
    r"|\bnovoresume\b|\bmyperfectresume\b|\bresumegenius\b|\bresumewriterdirect\b"
    r"|\bdownload (?:this|our) (?:template|resume)\b"
    r"|\b(?:template|resume) (?:designed|created) by\b"
    r"|\bfrom resume genius\b"
    r"|\binstall the font files\b"
    r"|\bfree resume builder\b|\bfree cover letter\b"
    r"|\bhow to write a (?:resume|cv|cover letter)\b"
    r"|\b(?:resume|cv|cover letter) (?:samples|examples) by industry\b"
    r"|\bcover letter builder\b"
    r"|\byou'?re also going to need a cover letter\b"
    r"|utm_source=word_doc|utm_medium="
)
#: Each alternative of VENDOR holds one of these: lines without any are not held to it.
VENDOR_SIGNS = ["resum", "job seeker", "hire one of our", "struggling", "good company", "money-zine", "zety", "template", "font files", "cover letter", "how to write", "by industry", "utm_"]
PLACEHOLDER = r"(?i)\byour (?:address|city|state|zip|phone|email|company)\b"
CITY_STATE_ZIP = r"^[A-Za-z .]{2,40},\s*[A-Z]{2},?\s*[0-9]{5}(-[0-9]{4})?$"
GLUED_ICON = r"^[a-z]{4,}[A-Z]{2,}$"
BARE_LINK = r"(?i)^(?:.*:\s*)?https?://\S+$"
BIRTH_DATE = r"^[0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:19|20)[0-9]{2}$"
COUNTRY = r"(?:USA|U\.S\.A\.?|United States(?: of America)?|UK|U\.K\.?|United Kingdom|UAE|U\.A\.E\.?|United Arab Emirates|India|Canada|Australia|Pakistan)"
EMPLOYMENT_TYPE = r"^(?:Full|Part|Full[\s-]?[Tt]ime|Part[\s-]?[Tt]ime|Contract|Freelance|Permanent|Temporary)$"
DECORATION = r"^[\s\-–—_=*.•●▪|/\\]+$"
PAGE_MARK = r"(?i)^\s*(?:page\s*)?[0-9]+\s*(?:of\s*[0-9]+)?\s*$"
LABEL_ONLY = r"(?i)^\s*(?:contact|address|phone|tel|telephone|mobile|email|e-mail|nationality|date of birth|dob|references?|curriculum vitae|cv|resume|personal details|profile|objective)\s*:?\s*$"
LABEL = r"(?i)^\s*(?:job title|title|contact|phone|tel|telephone|mobile|email|e-mail|address|name)\s*:\s*"

# Headings and what surrounds them.
QUALIFIER = r"^(?:SELECTED|SELECT|KEY|MAIN|MAJOR|RECENT|ADDITIONAL|OTHER|RELEVANT|CORE|NOTABLE)\s+"
TRAILING_YEARS = r"[\s,/-]*[0-9]{2,4}\s*[-–—]?\s*[0-9]{0,4}\s*$"
SUMMARY_OPENER = r"^(?:SUMMARY|PROFILE|OBJECTIVE|ABOUT|CAREER SUMMARY|CAREER OBJECTIVE|CAREER PROFILE|PERSONAL PROFILE|PERSONAL STATEMENT|EXECUTIVE SUMMARY)\b"
SEAM = r"\s{2,}|[•●▪‣⁃�·]\s*"
EMBEDDED_RUN = r"(?<=[a-z\)])\s+(?=(?:[A-Z][A-Z&/,.'-]*\s+){2,}[A-Z][A-Z&/,.'-]*(?:\s|$))"

# Where an item begins.
GERUND = r"^[A-Z][a-z]{2,}ing\b"
ENTRY_LABEL = r"^[A-Z][A-Za-z]{1,20}(?:[ /&-][A-Za-z.]{1,20}){0,3}:\s*\S"
CAPS_RUN = r"^(?:[A-Z][A-Z&/,.'-]*\s+){2,}[A-Z][A-Z&/,.'-]*(?:\s|$)"
DUTY = r"^[A-Z][a-z]+(?:ing|ed)\b.*[.!?]$"
EMPLOYER_TAIL = r"^[A-Z][\w .&'-]*?\s*/\s*[A-Za-z .]+,\s*[A-Z]{2}\s*/\s*(?:19|20)[0-9]{2}"
#: Openings of degree names that, with a year or an awarding body, begin a qualification.
DEGREE_OPENING = r"(?i)^(?:ph\.?\s?d|d\.?phil|ed\.?d|doctor of|m\.?phil|master|m\.?sc|m\.?a\b|mba|m\.?ed|m\.?eng|ll\.?m|bachelor|b\.?sc|b\.?a\b|b\.?eng|b\.?com|b\.?ed|ll\.?b|diploma|postgraduate|pg\s?cert|pgce|certificate)"
AWARDER = r"(?i)university|college|institute|academy|polytechnic|school of|expected|in progress|awarded|ongoing"

# Employment entries.
EDGES = r"[ ,:|()\[\]\-–—]"
REMNANT = r"^[\s|,;:.\-–—()]*[0-9]{0,4}[\s|,;:.\-–—()]*$"
NARRATIVE = r"[.!?]\s+\S"
TERMS = r"(?i)^(?:Full[\s-]?time|Part[\s-]?time|Contract|Freelance|Permanent|Temporary)\.?\s*"
CITY_STATE = r",\s*[A-Za-z .]+,\s*[A-Z]{2,4}\s*$"
COMPANY_FORM = r"(?i)^(?:Inc|LLC|L\.L\.C|Ltd|Corp|Co|LLP|PLC)\.?$"
PRACTICE = r"(?i)^(?:Special Projects and Conferences|Conference Presentations|Keynote Speeches)\b"
BARE_TITLE = r"^[A-Z][A-Za-z .&'-]{1,50}$"
EMPLOYER_LINE = r"^([A-Z][\w&'.-]*(?:\s+[A-Z][\w&'.-]*){0,2}),\s*([A-Za-z .]+),\s*([A-Z]{2,4})\s*[\(\s]*\s*((?:19|20)[0-9]{2})(?:\s*[-–—]\s*((?:19|20)[0-9]{2}|[Pp]resent|[Pp]resent [Tt]ime|[Cc]urrent))?"

# Countries as they are written, places that stand for one, degrees, institutions, and what ends a subject.
COUNTRIES = [
    "United Arab Emirates", "United Kingdom", "United States of America", "United States", "Saudi Arabia", "South Africa", "New Zealand", "Sri Lanka",
    "South Korea", "Hong Kong", "Netherlands", "Switzerland", "Singapore", "Australia", "Bangladesh", "Malaysia", "Pakistan", "Indonesia", "Germany",
    "Ireland", "Nigeria", "Denmark", "Belgium", "Sweden", "Norway", "Finland", "Austria", "Canada", "France", "Italy", "Spain", "Japan", "China",
    "India", "Egypt", "Kenya", "Ghana", "Qatar", "Oman", "Jordan", "Turkey", "Poland", "Greece", "Brazil", "Mexico", "Russia", "Bulgaria", "Romania",
    "Hungary", "Portugal", "Czech Republic", "Ukraine", "Philippines", "Thailand", "Vietnam", "Nepal", "Lebanon", "Kuwait", "Bahrain", "Iraq", "Iran",
    "Syria", "Yemen", "Palestine", "Libya", "Sudan", "Morocco", "Tunisia", "Algeria", "Ethiopia", "Tanzania", "Uganda", "Zimbabwe", "Argentina",
    "Chile", "Colombia", "Cyprus", "Malta", "Iceland", "Croatia", "Serbia", "Slovakia", "Slovenia", "Estonia", "Latvia", "Lithuania", "Luxembourg",
    "Scotland", "Wales", "England", "Northern Ireland", "Dubai", "Abu Dhabi", "Sharjah", "UAE", "UK", "USA", "U.K.", "U.S.A.",
]
PLACES = {"dubai": "United Arab Emirates", "abu dhabi": "United Arab Emirates", "sharjah": "United Arab Emirates", "uae": "United Arab Emirates", "uk": "United Kingdom", "u.k.": "United Kingdom", "usa": "United States", "u.s.a.": "United States"}
DEGREES = [
    "Doctor of Philosophy", "Doctor of Education", "Doctor of Business Administration", "Doctor of Psychology", r"Ph\.?\s?D\.?", r"D\.?Phil\.?",
    r"Ed\.?D\.?", "Doctorate", "Master of Business Administration", r"M\.?B\.?A\.?", "Master of Philosophy", r"M\.?Phil\.?", "Master of Science",
    "Master of Arts", "Master of Education", "Master of Engineering", "Master of Laws", r"M\.?Sc\.?", r"M\.?Res\.?", r"M\.?Eng\.?", r"M\.?Ed\.?",
    r"M\.?Tech\.?", r"M\.?Com\.?", r"LL\.?M\.?", r"M\.?A\.?", "Masters?", "Bachelor of Technology", "Bachelor of Engineering", "Bachelor of Science",
    "Bachelor of Arts", "Bachelor of Laws", "Bachelor of Commerce", "Bachelor of Education", "Bachelor of Business Administration", r"B\.?Sc\.?",
    r"B\.?Eng\.?", r"B\.?Tech\.?", r"B\.?Com\.?", r"LL\.?B\.?", r"B\.?A\.?", "Bachelors?", "Associate of Science", "Associate of Arts",
    "Associate Degree", "Higher Secondary Education", "Secondary School Certificate", "PGCHE", "PGCert", "PGCE", "PGDip", "Postgraduate Certificate",
    "Postgraduate Diploma", "Advanced Diploma", "Diploma", "Higher National Diploma", "HND",
]
INSTITUTION = r"\b([A-Z][\w.&'-]*(?:\s+[\w.&'-]+){0,6}\s+(?:University|College|Institute|Institution|Academy|Polytechnic|School)(?:\s+of\s+[\w.&'-]+(?:\s+[\w.&'-]+){0,3})?)\b"
INSTITUTION_OF = r"\b((?:University|Institute|College|Academy|School)\s+of\s+[A-Z][\w.&'-]*(?:\s+[\w.&'-]+){0,3})\b"
SUBJECT_END = r"(?i)\b(?:GPA|CGPA|Grade|Grades|Percentage|Marks|Thesis|Dissertation|Skills?|Knowledge|Modules?|Coursework|Distinction|Merit|Pass|First Class|Supervisor|Awarded|Expected|Completed)\b|[|/]|\s{3,}"

# Grants.
GRANT_LABEL = r"(?i)^(Project\s*Title|Role|Duration|Funding(?:\s+or\s+External\s+Agency)?|Value\s+to\s+the\s+University)\s*:\s*(.*)$"
FUNDED = r"(?i)\(\s*Funded by\s+(.+?)(?:,\s*([0-9]{4}[^)]*?))?\s*\)"
GRANT_FIELDS = {"project title": "project_title", "projecttitle": "project_title", "role": "role", "duration": "duration", "funding": "funding_agency", "funding or external agency": "funding_agency", "value to the university": "value_to_university"}

# Platforms by their addresses, in the order in which they are reported.
PLATFORMS = [
    ("ORCID", r"\b(?:https?://)?(?:www\.)?orcid\.org/([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9Xx])"),
    ("Scopus", r"\b(?:https?://)?(?:www\.)?scopus\.com/\S*?authorId=([0-9]+)"),
    ("Scopus", r"\b(?:https?://)?(?:www\.)?scopus\.com/(\S+)"),
    ("Google Scholar", r"\b(?:https?://)?scholar\.google\.[a-z.]+/\S*?user=([A-Za-z0-9_-]+)"),
    ("Google Scholar", r"\b(?:https?://)?scholar\.google\.[a-z.]+/(\S+)"),
    ("LinkedIn", r"\b(?:https?://)?(?:[a-z]{2,3}\.)?linkedin\.com/in/([A-Za-z0-9\-_%]+)"),
    ("ResearchGate", r"\b(?:https?://)?(?:www\.)?researchgate\.net/profile/([A-Za-z0-9\-_%]+)"),
    ("Web of Science / Publons", r"\b(?:https?://)?(?:www\.)?(?:publons\.com|webofscience\.com)/\S*?/([A-Za-z0-9\-/]+)"),
    ("GitHub", r"\b(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9\-_]+)"),
    ("Academia.edu", r"\b(?:https?://)?(?:[a-z]+\.)?academia\.edu/([A-Za-z0-9\-_]+)"),
]
BARE_ORCID = r"(?i)\bORCID\b[^0-9]{0,24}([0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9Xx])"

# What moves items.
ACTION_VERB = (
    r"(?i)^(?:designed|developed|implemented|diagnosed|managed|assisted|supported"
    r"|improved|optimi[sz]ed|gathered|identified|created|built|maintained"
    r"|configured|installed|troubleshot|resolved|delivered|coordinated"
    r"|performed|conducted|provided|prepared|established|automated|migrated"
    r"|deployed|tested|documented|monitored|handled|operated|acted)\b"
)
TRAINING = r"(?i)^(?:.*\b(?:certification|certificate|certified)\b|[\w .&'/-]+\bcourse\b\s*-\s*\S|.*-\s*(?:internship|certification|course)\s*$)"
CAPS_WORD, TITLE_CASE_WORD = r"[A-Z][A-Z'&]*", r"[A-Z][a-z'&]*"
JOB_HEADER = rf"^({CAPS_WORD}(?:\s+{CAPS_WORD}){{0,4}})\s+({TITLE_CASE_WORD}(?:[\s&.,'-]+{TITLE_CASE_WORD})*)\s*/\s*([A-Za-z .]+),\s*([A-Z]{{2}})\s*/\s*((?:19|20)[0-9]{{2}})(?:\s*[-–—]\s*((?:19|20)[0-9]{{2}}|[Pp]resent|[Pp]resent [Tt]ime|[Cc]urrent))?"
ONE_FACT = r"^(?:CITIZENSHIP|NATIONALITY|VISA STATUS|MARITAL STATUS|DATE OF BIRTH|PERSONAL DETAILS|GENDER)\b"
MEDIA_BLOCK = r"^(?:SELECTED MEDIA|MEDIA COVERAGE|MEDIA APPEARANCES|MEDIA MENTIONS|PRESS COVERAGE|PRESS MENTIONS|IN THE MEDIA)\b"
CITATION = r"(?i)[“”\"]|,\s*(?:19|20)[0-9]{2}\b|\((?:19|20)[0-9]{2}\)|\bvol(?:ume)?\.?\s*[0-9]"
SECOND_TITLE = r"(?i),?\s+and\s+((?:Head|Director|Dean|Chair|Provost|Vice[- ]Provost|Vice[- ]Chancellor|Pro[- ]Vice[- ]Chancellor|Assistant Dean|Associate Dean|Convenor|Coordinator)\s+of\b.*)$"
TAIL_INSTITUTION = r",\s*[A-Z][\w.&'-]*(?:\s+[\w.&'-]+){0,6}\s+(?:University|College|Institute|Institution|Academy|Polytechnic|School)(?:\s*,?\s*[A-Z][\w.&'-]*(?:\s+[\w.&'-]+){0,3}(?:\s+Campus)?)?\s*$"

# Words of a qualification, and letters whose names begin with a vowel.
QUALIFICATION_WORDS = [
    "phd", "doctor", "doctorate", "master", "bachelor", "mba", "msc", "bsc", "b.a", "m.a", "llb", "llm", "diploma", "degree", "certificate",
    "certification", "certified", "pgce", "pgcert", "a level", "o level", "university", "college", "institute", "academy", "school of",
]
SPOKEN_VOWEL = r"^(?:[AEFHILMNORSX][A-Z]|[aeiouAEIO])"

# Commands.
SET = r"(?i)^(?:set|change|update)\s+(?:the\s+)?(email|e-mail|phone|telephone|contact|job title|title|role|name|full name)\s*(?:to|=|as)?\s*[:\-]?\s*(.+)$"
ADD = r"(?i)^(?:add|insert)\s+(.+?)\s+(?:to|under|in|into)\s+(.+)$"
VERB = r"(?i)^(approve|accept|reject|remove)\b(.*)$"

# Letterheads.
CONTACT_LABEL = r"(?i)\b(?:phone|tel(?:ephone)?|mob(?:ile)?|cell|e-?mail|address|contact)\b\s*:?"
#: Each alternative of CONTACT_LABEL holds one of these.
CONTACT_SIGN = r"(?i)phone|tel|mob|cell|mail|address|contact"
TITLE_LABEL = r"(?i)^job\s*titles?\s*:?\s*"
CONTACT_LEAD = r"(?i)^contact(?:\s+(?:details|info(?:rmation)?|number))?\s*:?\s*"
LETTERHEAD_LABEL = r"(?i)^\s*(?:job\s*titles?|title|contact|phone|tel|telephone|mobile|email|e-mail|address|name)\s*:\s*"
FILE_NOISE = [
    "cv", "cvs", "resume", "resumé", "curriculum", "vitae", "profile", "bio",
    "final", "draft", "updated", "update", "new", "copy", "latest", "version",
    "doc", "docx", "pdf", "signed", "revised",
]
MONTH_PREFIX = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
LANGUAGE_LIST = r"(?i)^languages?(?:\s+known)?\s*:\s*[A-Za-z].{2,80}$"

# Addresses that are no one's own, where own ones stand, and addresses that a line break cut.
ANY_URL = r"(?i)\bhttps?://[^\s,;<>()\[\]\"']+"
NOT_OWN_URL = (
    r"(?i)doi\.org|dx\.doi|/doi/|springer|elsevier|wiley|tandfonline|sciencedirect"
    r"|jstor|researchsquare|arxiv|ssrn|pubmed|ncbi\.nlm|plos\.org|journals\."
    r"|biomedcentral|frontiersin|mdpi\.com|sagepub|emerald|inderscience"
    r"|/article|/articles/|/chapters/|/hub/|/blog/|/publication"
    r"|drive\.google|docs\.google|dropbox|zoom\.us|teams\.microsoft"
    r"|youtube\.com|youtu\.be|twitter\.com|x\.com|facebook\.com|instagram\.com"
    r"|resumethatworks|money-zine|resume\.io|zety\.com|novoresume"
    r"|myperfectresume|resumegenius|/order\.php"
    r"|\.pdf$"
)
PROFILE_HEADING = r"(?i)\b(?:profiles?|links?|identifiers?|online presence|social media|web)\b"
CUT_URL = r"[-_]$"
LETTERHEAD_LINES, SHORTEST_URL = 25, 12

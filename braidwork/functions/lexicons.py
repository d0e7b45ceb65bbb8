"""Word lists and patterns whose values are fixed by the behaviour to be matched."""

from __future__ import annotations

# Technical terms looked for in any document.
TECH_TERMS = (
    "python", "java", "javascript", "typescript", "c++", "c#", "php",
    "go", "rust", "swift", "kotlin", "ruby", "scala", "perl",
    "react", "angular", "vue", "nodejs", "django", "flask", "spring",
    "sql", "mysql", "postgresql", "mongodb", "oracle", "redis",
    "aws", "azure", "gcp", "docker", "kubernetes", "jenkins",
    "html", "css", "sass", "less", "webpack", "babel",
    "tensorflow", "pytorch", "scikit-learn", "pandas", "numpy",
    "git", "github", "gitlab", "jira", "confluence",
    "linux", "unix", "windows", "bash", "powershell",
    "rest", "graphql", "soap", "grpc",
)

# Terms by category.
CATEGORIES = {
    "programming": ("java", "javascript", "python", "c++", "c#", "php", "ruby", "swift", "kotlin", "r-style", "typescript", "go", "rust", "scala"),
    "framework": ("spring", "spring boot", "springboot", "spring mvc", "spring security", "hibernate", "jpa", "jdbc", "junit", "bootstrap", "bootstrap3", "jquery", "react", "angular", "vue", "nodejs"),
    "database": ("mysql", "mongodb", "postgresql", "oracle", "redis", "sql", "nosql", "mariadb", "cassandra", "elasticsearch"),
    "tool": ("git", "github", "maven", "eclipse", "intellij", "postman", "swagger", "jira", "confluence", "jenkins", "docker"),
}

# Terms whose presence in both texts raises the TF-IDF score.
BOOST_TERMS = (
    "python", "java", "javascript", "react", "angular", "vue", "docker",
    "kubernetes", "aws", "azure", "sql", "nosql", "mongodb", "postgresql",
    "c++", "c#", "php", "ruby", "go", "rust", "typescript", "nodejs",
    "django", "flask", "spring", "hibernate", "jpa", "rest", "graphql",
)

# Words dropped from skill phrases.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "experience", "skill", "knowledge", "ability", "proficient",
)

# Words dropped from frequency keywords.
KEYWORD_STOP_WORDS = (
    "the", "and", "for", "with", "this", "that", "from", "have", "will", "your", "you", "are", "can", "was", "has", "not",
    "but", "all", "any", "experience", "work", "job", "skills",
)

# Soft skills and ways of working.
SOFT_SKILLS = (
    "remote", "work from home", "wfh", "distributed team", "async", "asynchronous", "communication", "teamwork",
    "collaboration", "leadership", "problem solving", "critical thinking", "time management", "agile", "scrum",
    "self-motivated", "independent", "fast learner",
)

# What the document checks look for.
EDUCATION_WORDS = ("university", "college", "institute", "bachelor", "master", "phd", "bs", "ms", "ba", "ma", "degree")
OUTDATED_TECH = ("flash", "silverlight", "vb6", "cobol", "fortran", "jquery 1", "ie6", "ie7", "ie8")
MODERN_TECH = ("react", "angular", "vue", "python", "aws")
TEMPLATE_PHRASES = (
    "to whom it may concern", "i am writing to apply", "i have attached my resume", "dear hiring manager",
    "i am confident that my skills", "i would welcome the opportunity",
)
TOWNS = ("Herzliya", "Tel Aviv", "Jerusalem", "Haifa", "Beer Sheva", "Raanana", "Petah Tikva")
BULLETS = ("•", "-", "*", "·")
EXPERIENCE_HEADERS = ("experience", "work experience", "professional experience", "employment history", "work history")
STOP_HEADERS = ("education", "skills", "projects", "certifications", "training", "languages", "additional", "publications", "courses", "certificates")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Marker of importance, and what it adds to the weight of a skill named after it in its line.
IMPORTANCE = (("must have", 0.5), ("required", 0.4), ("essential", 0.4), ("need", 0.3), ("prefer", -0.2), ("plus", -0.2), ("nice to have", -0.3))
CRITICAL = ("must have", "required", "essential")

# Patterns of sections and figures. They mean the same to Java and RE2.
W = r"[\p{L}\p{N}_]"
SECTION_SKILLS = (
    r"(?is)(?:skills|technologies|competencies|expertise)[:\s]*(.+?)(?:\n\s*\n|\n\s*[a-z]|\z)",
    r"(?is)(?:technical|professional)\s+(?:skills?|experience)[:\s]*(.+?)(?:\n\s*\n|\z)",
    r"(?is)(?:programming languages?|frameworks?|tools?)[:\s]*(.+?)(?:\n\s*\n|\z)",
)
SECTION_TECH = (
    r"(?is)(?:technologies\s*(?:&\s*)?frameworks?|tech\s*stack|tools\s*summary)[:\s]*(.+?)(?:\n\s*\n|\n\s*[A-Z]|\z)",
    r"(?is)(?:skills|competencies)[:\s]*(.+?)(?:\n\s*\n|\n\s*[A-Z]|\z)",
)
SECTION_CHUNKS = tuple(
    rf"(?is)(?:^|\n)(?:{names})[^\n]*\n(.*?)(?:\n\s*\n|\n\s*[A-Z]|\z)"
    for names in ("experience|work history|employment", "education|academic", "skills|technologies|competencies", "projects?|portfolio", "certifications?|licenses", "languages")
)
PERIOD_DASH = r"(?:^|[^\p{L}\p{N}_])((?:19|20)\d{2})\s*[-–—]\s*((?:19|20)\d{2}|now|present)"
PERIOD_TO = r"(?:^|[^\p{L}\p{N}_])((?:19|20)\d{2})\s*to\s*((?:19|20)\d{2}|now|present)"
PERIOD_ANY = r"(?:^|[^\p{L}\p{N}_])(\d{4})\s*[-–—]\s*([\p{L}\p{N}_]+)"
REQUIRED_YEARS = r"(?i)(\d+)\+?\s*(?:plus\s*)?years?\s+of\s+experience"
EXPLICIT_YEARS = (r"(?i)(\d+)\+?\s*years?\s+of\s+experience", r"(?i)(\d+)\+?\s*years?\s+experience", r"(?i)experience\s+of\s+(\d+)\+?\s*years?", r"(?i)(\d+)\+?\s*years?", r"(?i)(\d+)\+?\s*yr?s?\s+exp")
EMAIL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
PHONE = r"\+?[\d\s\-()]{10,}"
LOCATION = r"(?i)(?:^|[^\p{L}\p{N}_])(?:located|based|residence|city)[\s:]+[a-z][a-z]+(?:\s+[a-z][a-z]+)*(?:$|[^\p{L}\p{N}_])"
DEGREE_IN = r"(?i)(?:^|[^\p{L}\p{N}_])(?:bachelor|master|phd|bs|ms|ba|ma)['\x22]?s?\s+in"
DEGREE_YEAR = r"(?is)(?:bachelor|master|phd).*?\d{4}"
MUST_SECTION = r"(?is)(?:must have|required|essential|qualifications?)[:\s]+(.*?)(?:\n\s*\n|\.\s+[A-Z]|\z)"
MUST_LIST = r"(?s)(?:must have|required|essential|minimum)[:\s]+(.*?)(?:\n\s*\n|\z)"
NICE_LIST = r"(?s)(?:nice to have|preferred|plus|desired)[:\s]+(.*?)(?:\n\s*\n|\z)"
EDUCATION_IN = (r"bachelor(?:[\x22']?s)?\s+(?:degree\s+)?in\s+([^.]+)", r"master(?:[\x22']?s)?\s+(?:degree\s+)?in\s+([^.]+)", r"phd\s+in\s+([^.]+)", r"bs\s+in\s+([^.]+)", r"ms\s+in\s+([^.]+)")
CERTIFIED = r"(?:certified|certification|certificate)[:\s]+([^.]+)"
WORK_PERIODS = (
    (r"(?i)(\d{4})\s*[-–—]\s*(\d{4}|now|present|current)", 1, 2),
    (r"(?i)(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{4})\s*[-–—]\s*(now|present|current)", 1, 2),
    (r"(?i)(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{4})\s*[-–—]\s*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{4})", 1, 2),
    (r"(\d{4})\s+(\d{4})", 1, 2),
)
DATE_MENTION = r"(?i)(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+)?(?:19|20)\d{2}|now|present|current"
ENTITY = r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
SPACE = r"[\s\p{Z}\x0b\x85]"

# Frequent words of six languages, to tell English and Russian from others.
FREQUENT_WORDS = {
    "en": ("the", "and", "of", "to", "in", "for", "with", "is", "that", "on", "as", "by", "from", "at", "an"),
    "de": ("der", "die", "und", "das", "mit", "ein", "eine", "für", "von", "zu", "auf", "ist", "bei", "aus", "wurde"),
    "fr": ("le", "la", "les", "et", "des", "une", "pour", "dans", "est", "avec", "du", "sur", "par", "en", "qui"),
    "es": ("el", "la", "los", "y", "del", "una", "para", "que", "con", "se", "por", "las", "en", "un", "al"),
    "pt": ("o", "os", "e", "da", "do", "uma", "para", "que", "com", "em", "um", "na", "no", "dos", "as"),
}

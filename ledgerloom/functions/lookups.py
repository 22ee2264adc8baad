"""Dictionaries, trust tables, weights, patterns. All are plain data."""

from __future__ import annotations

# Country spellings (lower case) to ISO 3166-1 alpha-2.
COUNTRIES = {
    "united states": "US", "united states of america": "US", "usa": "US", "u.s.a.": "US", "u.s.": "US", "america": "US",
    "united kingdom": "GB", "uk": "GB", "u.k.": "GB", "great britain": "GB", "england": "GB",
    "india": "IN", "canada": "CA", "germany": "DE", "deutschland": "DE", "france": "FR", "ireland": "IE",
    "netherlands": "NL", "australia": "AU", "singapore": "SG", "brazil": "BR", "japan": "JP",
}

# Skill spellings (lower case, no trailing dots) to their display names.
SKILLS = {
    "js": "JavaScript", "javascript": "JavaScript", "ecmascript": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript",
    "py": "Python", "python": "Python", "python3": "Python", "golang": "Go", "go": "Go",
    "reactjs": "React", "react.js": "React", "react": "React", "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js",
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "psql": "PostgreSQL", "k8s": "Kubernetes", "kubernetes": "Kubernetes",
    "ml": "Machine Learning", "machine learning": "Machine Learning", "c++": "C++", "cpp": "C++", "cplusplus": "C++",
    "sql": "SQL", "java": "Java", "rust": "Rust", "scala": "Scala", "aws": "AWS", "gcp": "GCP", "docker": "Docker",
    "spark": "Apache Spark", "apache spark": "Apache Spark", "kafka": "Apache Kafka", "apache kafka": "Apache Kafka",
    "tensorflow": "TensorFlow", "pytorch": "PyTorch", "django": "Django", "flask": "Flask",
}

# The first three letters of English months to their numbers.
MONTHS = {m: f"{i:02d}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

# Words for a role that goes on.
PRESENT_WORDS = ["present", "current", "now", "ongoing"]

# How far a source type is trusted, and for which fields otherwise.
DEFAULT_TRUST = {"recruiter_csv": 0.90, "ats_json": 0.85, "linkedin": 0.75, "github_api": 0.60, "resume": 0.55, "recruiter_notes": 0.40}
# Fixed value: trust of source types that have none.
UNKNOWN_TRUST = 0.5
FIELD_TRUST = {
    ("github_api", "skills"): 0.95, ("github_api", "links.github"): 0.99, ("github_api", "phones"): 0.0,
    ("linkedin", "headline"): 0.90, ("linkedin", "links.linkedin"): 0.99,
    ("resume", "experience"): 0.80, ("resume", "education"): 0.85, ("resume", "skills"): 0.70,
    ("recruiter_notes", "phones"): 0.55, ("recruiter_notes", "skills"): 0.45,
}
# Fixed value: the date of sources without one.
EPOCH = "1970-01-01"

# The fields of a record with one value, and with a list of texts, in order.
SCALAR_FIELDS = ["full_name", "headline", "years_experience", "location.city", "location.region", "location.country", "links.linkedin", "links.github", "links.portfolio"]
MULTI_FIELDS = ["emails", "phones", "links.other"]

# Weights of the overall confidence, in summation order, and the confidences of list fields.
OVERALL_WEIGHTS = {"full_name": 3.0, "emails": 2.5, "phones": 1.5, "headline": 1.0, "skills": 1.5, "experience": 1.5, "education": 1.0, "location.country": 0.8, "years_experience": 0.8}
LIST_CONFIDENCE = {"emails": 0.9, "phones": 0.7, "experience": 0.8, "education": 0.8}
AGREEMENT, CONFLICT, SKILL_AGREEMENT, DECAY = 0.12, 0.08, 0.1, 0.6

# Patterns (java.util.regex).
EMAIL = r"[^@\s]+@[^@\s]+\.[^@\s]+"
DATE_YEAR_MONTH = r"(\d{4})-(\d{1,2})"
DATE_MONTH_YEAR = r"(\d{1,2})/(\d{4})"
DATE_NAMED_MONTH = r"([a-z]{3,4})\.?\s+(\d{4})"
FIND_EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
FIND_PHONE = r"\+?\d[\d\s().-]{7,}\d"
NAME_LINE = r"[A-Za-z][A-Za-z.'\- ]{2,40}"
EXPERIENCE_LINE = r"(?i)(.+?),\s*(.+?)\s*\((\d{4}(?:-\d{2})?)\s*[-–to]+\s*(present|\d{4}(?:-\d{2})?)\)"
EDUCATION_LINE = r"(?i)(.+?)\s+in\s+(.+?),\s*(.+?),\s*(\d{4})"
SKILL_PHRASE = r"(?i)(?:skills?|strong in|expertise in)[:\s]+([A-Za-z0-9+#.,/ &-]+)"
NOTES_SEPARATOR = r",|/| and "
FILLER = r"(?i)^(also|and|or|the|with|in)\s+"
BULLETS = r"^[•\-\s]+"
SKILL_SEPARATOR = r",|/|•|\|"
SKILL_EDGES = r"^[.\-\s]+|[.\-\s]+$"
SECTIONS = {"skills": "skills", "technical skills": "skills", "experience": "experience", "work experience": "experience", "employment": "experience", "education": "education"}
LONGEST_SKILL = 30

"""Seven documents of one invented candidate, a configuration, and what must come of them (worked out by hand)."""

import json

MIRA = {
    "manifest.json": json.dumps(
        {
            "candidate_id": "mira-77",
            "sources": [
                {"type": "recruiter_notes", "path": "call.txt", "timestamp": "2025-11-02"},
                {"type": "ats_json", "path": "half.json", "timestamp": "2025-11-03"},
                {"type": "linkedin", "path": "network.json", "timestamp": "2025-09-30"},
                {"type": "recruiter_csv", "path": "export.csv"},
                {"type": "github_api", "path": "code.json", "timestamp": "2025-10-05"},
                {"type": "resume", "path": "cv.txt", "timestamp": "2024-01"},
                {"type": "ats_json", "path": "system.json", "timestamp": "2025-10-01", "trust": 0.95},
            ],
        }
    ),
    "call.txt": "Short call. Expertise in Scala, and k8s!\nReach her on 0049 30 5550188 after six.\n",
    "half.json": '{"fullName": "Mira Holt", "emails": [',
    "network.json": """{'name': 'Mira Holt', headline: 'Pipelines and tea', 'profileUrl': ' https://www.linkedin.com/in/miraholt ', 'location': 'Hamburg, Deutschland',
      'experience': [{'company': 'Kranich Logistics', 'title': 'Data Engineer', 'start': '2019-4', 'end': 'present', 'summary': 'Runs the freight lake.'},
                     {'company': 'Uferwerk', 'title': 'Analyst', 'start': 'Feb 2016', 'end': '03/2019'}],
      'education': [{'institution': 'TU Hamburg', 'degree': 'MSc', 'field': 'Statistics', 'end': 'summer of 2015'}], 'skills': ['Scala', 'SQL']} // exported""",
    "export.csv": 'location,Name,email,phone,title,current_company\n"Hamburg, HH, Germany",Mira J. Holt,MIRA@holt.example,+49 30 5550188,Data Engineer,kranich logistics\n',
    "code.json": '{"login": "mjholt", "name": "mira holt", "bio": null, "blog": "https://holt.example/notes", "location": "Germany", "languages": ["scala", "rust"]}',
    "cv.txt": "\n  Mira Holt\nmira@holt.example, m.holt@oldpost.example\n\nTechnical Skills:\n• Rust / SQL | dbt.\n\nWork Experience\n- Analyst, Uferwerk (2016-02 to 2019-03)\n- no dates here\n\nEducation\nMSc in Statistics, TU Hamburg, 2015\n",
    "system.json": '{"name": "Mira Holt", "email": "mira@holt.example", "yoe": 8, "summary": "Pipelines and tea", "location": {"town": "Hamburg", "countryCode": "de"}, "skills": "SQL", "links": ["https://holt.example/notes", " "]}',
}

#: Claims of each source, in the manifest's order.
CLAIMS = [3, 0, 10, 8, 6, 8, 8]

CONFIG = {
    "fields": [
        {"path": "person.name", "from": "full_name", "required": True},
        {"path": "person.mail", "from": "emails[0]", "normalize": "email"},
        {"path": "reach", "from": "phones[0]", "normalize": "E164"},
        {"path": "tools", "from": "skills[].name", "type": "string[]"},
        {"path": "site", "from": "links.portfolio"},
        {"path": "years", "from": "years_experience", "type": "number"},
    ],
    "include_confidence": False,
    "on_missing": "omit",
}

OUTPUT = {"person": {"name": "Mira Holt", "mail": "mira@holt.example"}, "reach": "+49305550188", "tools": ["dbt", "Kubernetes", "Rust", "Scala", "SQL"], "years": 8}


def laid_out(folder, files):
    """Writes a candidate's files into a folder; the manifest's path."""
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder / "manifest.json")

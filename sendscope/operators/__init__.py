from . import checks, diagnosis, payload, prepare, profile, search, sequence, sessions, templates

__all__ = ["checks", "diagnosis", "payload", "prepare", "profile", "search", "sequence",
           "sessions", "templates"]

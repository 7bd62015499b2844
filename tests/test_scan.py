"""Programs with `expect` marks on their sink lines: the scan's findings must be those, exactly."""

import re

from pyspark.sql import functions as F

from dataspoor.operators import scan as S
from dataspoor.sources import catalogue, python, scripts

PYTHON = {
    "app/log.py": """
import logging
import json
logger = logging.getLogger(__name__)

def signup(request):
    email = request.form['email']
    note = f"new {email}"
    logger.info(note)  # expect: PF001
    logging.info(len(email))
    logging.info("ready")
    body = {'address': email, 'n': 1}
    logging.warning(json.dumps(body))  # expect: PF001
    logging.info(body['n'])
""",
    "app/send.py": """
import requests, openai, bcrypt
from app.util import mask, relay

def login(user):
    secret = user.password
    hashed = bcrypt.hashpw(secret, b"s")
    print(hashed)
    print(secret)  # expect: PF005
    requests.post("https://api.example.com/v1", json={"p": user.email})  # expect: PF002
    requests.post("/local", json=user.email)
    requests.get(user.homepage_url, params={"e": user.email})  # expect: PF006
    openai.OpenAI().chat.completions.create(messages=[user.email])  # expect: PF002 PF003
    relay(user.phone_number)
    print(mask(user.phone_number))

def clean(record):
    if record.religion.startswith("x"):
        print(record.health_record_id)  # expect: PF001
""",
    "app/util.py": """
import logging

def mask(value):
    return "***"

def relay(phone):
    deeper(phone)

def deeper(x):
    logging.error("call %s", x)  # expect: PF001
""",
    "app/cls.py": """
import logging

class Account:
    def __init__(self, source):
        self.mail = source.email
        self.size = 3

    def show(self):
        logging.info(self.mail)  # expect: PF001
        logging.info(self.size)
""",
    "bad.py": "def (:\n",
}
SCRIPT = {
    "src/log.ts": """
import pino from 'pino';
import * as fs from 'fs';
import { Request, type Response } from 'express';
const logger = pino({ level: 'info' });
interface Body { email: string; n: number }

export async function signup(req: Request, res: Response): Promise<void> {
  const { email, n } = req.body as Body;
  const note = `new ${email}`;
  logger.info(note); // expect: PF001
  console.log(n);
  const kept = n > 3 ? email.trim() : undefined;
  console.error(kept!); // expect: PF001
  if (email === 'x') { console.log('same'); }
}

export const save = async (user: { phone: string }): Promise<string> => {
  await fetch('https://api.example.com/v1', { method: 'POST', body: JSON.stringify({ p: user.phone }) }); // expect: PF002
  await fetch('/api/local', { body: user.phone });
  return user.phone;
};

class Mailer {
  private to = '';
  constructor(private readonly account: any) { this.to = account.email; }
  send<T>(x: T): void {
    console.info(this.to); // expect: PF001
    console.info(x);
  }
}

function relay(value: string) { console.warn(value); } // expect: PF001 PF005
save({ phone: '1' }).then((r) => r);
export default function run(u: any) { relay(u.password_hash ?? ''); relay(u.city); }
""",
}


def marks(files):
    out = set()
    for path, text in files.items():
        for n, line in enumerate(text.split("\n"), 1):
            if m := re.search(r"expect: ([\w ]+)", line):
                out |= {(r, path, n) for r in m[1].split()}
    return out


def held(spark, files, lower, lang, methods):
    rows = spark.createDataFrame([("", p, t) for p, t in files.items()], "repo string, path string, text string")
    return S.scan(lower(rows), lang, catalogue.rules(spark).filter(F.col("lang") == lang), methods)


def test_python_marks(spark):
    r = held(spark, PYTHON, python.lower_files, "python", catalogue.PY_METHODS)
    found = {(x.rule_id, x.path, x.line) for x in r.findings.collect()}
    assert found == marks(PYTHON)
    assert {(g.kind, g.first_path) for g in r.gaps.collect()} >= {("parse_error", "bad.py")}
    assert {x.processor for x in r.egress.collect()} >= {"api.example.com", "OpenAI"}


def test_ids_outlive_added_lines(spark):
    one = held(spark, {"a.py": PYTHON["app/log.py"]}, python.lower_files, "python", catalogue.PY_METHODS)
    two = held(spark, {"a.py": "# a comment\n\n" + PYTHON["app/log.py"]}, python.lower_files, "python", catalogue.PY_METHODS)
    ids = lambda r: {x.id for x in r.findings.collect()}
    assert ids(one) == ids(two) and len(ids(one)) == 2


def test_repositories_stay_apart(spark):
    rows = [(repo, p, t) for repo in ("one", "two") for p, t in PYTHON.items()]
    r = S.scan_python(spark.createDataFrame(rows, "repo string, path string, text string")).collect()
    assert {(x.rule_id, x.path, x.line) for x in r if x.repo == "one"} == {(x.rule_id, x.path, x.line) for x in r if x.repo == "two"} == marks(PYTHON)


def test_script_marks(spark):
    methods = {"args_to_result": ("trim", "toLowerCase", "toString", "concat", "then"), "args_to_receiver": ("push",)}
    r = held(spark, SCRIPT, scripts.lower_files, "javascript", methods)
    assert {(x.rule_id, x.path, x.line) for x in r.findings.collect()} == marks(SCRIPT)
    assert not [x for x in r.gaps.collect() if x.kind == "parse_error"]


def test_whole_trees_and_configuration(spark, tmp_path):
    from dataspoor import cli
    from dataspoor.sources import config

    tree = {"a/" + p: t for p, t in PYTHON.items() if p == "app/log.py"} | SCRIPT | {"x.go": "package main", "y.cs": "class A {}", "z.cshtml": "x", "node_modules/m/i.js": "console.log(u.email)"}
    rows = spark.createDataFrame([("", p, t) for p, t in tree.items()], "repo string, path string, text string")
    r = S.scan_files(rows, config.load({"policy": {"rules": {"PF005": {"enabled": False}}}, "processors": [{"name": "Api", "hosts": ["example.com"], "citation": "c"}]}))
    found = {(x.rule_id, x.path, x.line) for x in r.findings.collect()}
    assert found == {m for m in marks(tree) if m[0] not in ("PF005", "PF002")}
    assert ("unsupported_language", "go") in {(g.kind, g.detail) for g in r.gaps.collect()}
    for p, t in tree.items():
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_text(t)
    assert cli.scan(spark, str(tmp_path / "t"), str(tmp_path / "out.sarif"), config.Config()) in (1, 4)
    import json

    text = "".join(x.read_text() for x in sorted((tmp_path / "out.sarif").glob("part-*")))
    assert {x["ruleId"] for x in json.loads(text)["runs"][0]["results"]} == {"PF001", "PF002", "PF005"}
    assert cli.main(["scan", str(tmp_path), "--config", str(tmp_path / "none.json")]) == 3


HANDLERS_PY = {
    "app/api.py": """
import logging
from fastapi import FastAPI, Request, APIRouter
from app.models import UserIn
app = FastAPI()
router = APIRouter()

@app.post("/u")
def create(body, user: UserIn, request: Request, db: Session):
    logging.info(body)  # expect: PF004
    logging.info(user)
    logging.info(user.email)  # expect: PF001
    logging.info(db)
    logging.info(request)
    logging.info(request.headers)  # expect: PF004
    logging.info(request.json())  # expect: PF004

def plain(body):
    logging.info(body)

class UserIn:
    pass
""",
    "app/views.py": """
import logging

class Profile:
    def post(self, request):
        logging.info(request.POST)  # expect: PF004
        logging.info(request.user_agent_tag)
""",
    "app/flask_app.py": """
import logging
import tornado.web
from flask import request

def up():
    logging.info(request.get_json())  # expect: PF004
    logging.info(request.args)  # expect: PF004
""",
}
HANDLERS_JS = {
    "src/server.js": """
import express from "express";
import Koa from "koa";
const app = express();
app.post("/signup", (req, res) => { console.log(req.body); console.log(res.body); }); // expect: PF004
function handler(req, res) {
  console.log(req.query); // expect: PF004
  console.log(req.ip); // expect: PF001
}
app.get("/x", handler);
function other(req) { console.log(req.query); }
""",
    "app/users/route.ts": """
export async function POST(request: Request) {
  const b = await request.json();
  console.log(b); // expect: PF004
}
export const helper = (request) => { console.log(request.json()); };
""",
    "pages/api/x.js": """
export default function run(req, res) { console.log(req.body); } // expect: PF004
""",
}


def test_handlers_of_frameworks(spark):
    for files, lower, lang, methods, foreign in ((HANDLERS_PY, python.lower_files, "python", catalogue.PY_METHODS, "Tornado"), (HANDLERS_JS, scripts.lower_files, "javascript", catalogue.JS_METHODS, "Koa")):
        r = held(spark, files, lower, lang, methods)
        at = {(x.path, x.line) for x in r.flows.join(r.sinks.withColumnRenamed("id", "sink"), "sink").collect()}
        assert at == {(p, n) for _, p, n in marks(files)}
        assert ("unsupported_framework", foreign) in {(g.kind, g.detail) for g in r.gaps.collect()}


def test_every_sink_entry_is_decided(spark):
    """A path made of each entry's first pattern meets that entry, or one before it that covers the path too."""
    from dataspoor.operators import lookup as L
    from dataspoor.sources import values as V

    def made(p):
        p = re.sub(r"\{([^{},]*)[^{}]*\}", r"\1", re.sub(r"\{([^{},]*)[^{}]*\}", r"\1", p))
        return p.replace("**.", "").replace("**", "x").replace("*", "x")

    rows = [(n, made(calls.split()[0]), catalogue.lang_of(e)) for n, (e, _, _, calls) in enumerate(V.SINKS) if calls]
    got = {r.stmt: (r.kind, r.entry) for r in L.decide(spark.createDataFrame(rows, "stmt int, path string, lang string"), catalogue.rules(spark)).collect()}
    assert len(got) == 143 and all(kind == "sink" for kind, _ in got.values())
    assert sum(got[n][1] == V.SINKS[n][0] for n, _, _ in rows) >= 135
    assert (len(V.SINKS), len(V.SOURCES), len(V.PROPAGATORS), len(V.SANITISERS), len(V.FRAMEWORKS)) == (148, 20, 26, 6, 43)

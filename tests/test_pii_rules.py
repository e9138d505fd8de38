"""One text for each rule for personal data, by what it finds after overlaps are settled."""

import pytest

from tracemill.operators import curation as K

FOUND = {
    "github_url_username": ("see github.com/jdoe now", "jdoe"),
    "github_raw_url_username": ("raw.githubusercontent.com/jdoe", "jdoe"),
    "email": ("to bob@example.com", "bob@example.com"),
    "email_truncated": ("jane.doe@ on a line", "jane.doe"),
    "telegram_bot_token": ("123456789:AAabcdefghijklmnopqrstuvwxyz01234", "123456789:AAabcdefghijklmnopqrstuvwxyz01234"),
    "personal_hostname": ("on alice-macbook-pro", "alice-macbook-pro"),
    "home_dir_path": ("in /home/alice/work/a.txt", "/home/alice/work/a.txt"),
    "private_ip_10": ("at 10.1.2.3", "10.1.2.3"),
    "private_ip_172": ("at 172.16.2.3", "172.16.2.3"),
    "private_ip_192": ("at 192.168.2.3", "192.168.2.3"),
    "mac_address": ("00:1A:2b:3c:4D:5e", "00:1A:2b:3c:4D:5e"),
    "ssn_us": ("ssn 123-45-6789", "123-45-6789"),
    "phone_e164": ("call +49 30 1234567", "+49 30 1234567"),
    "internal_tld_host": ("host Build.Corp", "Build.Corp"),
    "private_ip_url": ("open https://10.0.0.7:8443/admin?x=1 now", "https://10.0.0.7:8443/admin?x=1"),
    "localhost_url": ("http://localhost:8080/x", "http://localhost:8080/x"),
    "npm_scoped_package": ("add @acme/web-ui", "@acme/web-ui"),
    "package_at_version": ("uses atlas-core@1.2.3-rc.1 here", "atlas-core@1.2.3-rc.1"),
    "github_repo_slug": ("clone github.com/openai/secret-plan", "openai/secret-plan"),
    "gitlab_repo_slug": ("clone gitlab.com/team/group/tool", "team/group/tool"),
    "bitbucket_repo_slug": ("clone bitbucket.org/team/tool", "team/tool"),
    "aws_arn": ("arn:aws:iam::123456789012:role/ops", "arn:aws:iam::123456789012:role/ops"),
    "aws_account_ecr": ("pull 123456789012.dkr.ecr.eu-west-1.amazonaws.com/app", "123456789012.dkr.ecr.eu-west-1.amazonaws.com"),
    "gcp_project_id": ("projects/atlas-prod-17/x", "atlas-prod-17"),
    "credit_card": ("4111 1111 1111 1111", "4111 1111 1111 1111"),
    "meta_username": ('{"username": "jdoe"}', "jdoe"),
    "meta_sender_id": ('{"sender_id": "u-77"}', "u-77"),
    "meta_user_chat_id": (r'{\"chat_id\": \"c-99\"}', "c-99"),
    "meta_numeric_id": ('{"id": "1234567"}', "1234567"),
    "meta_name": ('{"name": "Jane Doe"}', "Jane Doe"),
    "meta_sender": ('{"sender": "Jane Doe"}', "Jane Doe"),
    "meta_label": ('{"label": "Jane Doe"}', "Jane Doe"),
}


@pytest.fixture(scope="module")
def spans(spark):
    docs = [(rule, text) for rule, (text, _) in FOUND.items()]
    docs += [("skipped", "github.com/OpenAI and raw.githubusercontent.com/python and noreply@x.org and {\"name\": \"[NAME]\"}")]
    return K.pii_spans(spark.createDataFrame(docs, "id string, text string"), "id", "text").collect()


def test_every_rule_has_a_text():
    assert set(FOUND) == {rule for rule, *_ in K.PII_RULES} and len(K.PII_RULES) == 32


@pytest.mark.parametrize("rule", sorted(FOUND))
def test_rule(spans, rule):
    text, entity = FOUND[rule]
    found = [(r["rule"], r["entity"], text[r["start"] : r["end"]]) for r in spans if r["id"] == rule]
    assert found == [(rule, entity, entity)]


def test_public_organisations_are_skipped(spans):
    assert [r["entity"] for r in spans if r["id"] == "skipped"] == []

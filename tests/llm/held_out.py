"""Hand-written lines for the accuracy of personal.py: their sentences, names and streets are not in its labelled table.

A mention stands in brackets with its kind in front, as in [name:...].
"""

import re

KINDS = {"n": "name", "e": "email", "p": "phone", "a": "address", "i": "id_number"}
LINES = """
Minutes of the call: [n:Ingrid Solheim] asked whether the migration could wait.
The outage was first reported by [n:Thomas Müller], who then called [p:0171 2345678] for help.
[n:Aiko Tanaka] and [n:David Okafor] paired on the fix all afternoon.
I left a voicemail for Dr. [n:Holloway] but she has not returned it.
If in doubt, ping [n:Priyanka Desai] ([e:priyanka.desai@fernbank.org]).
Our landlord Mr. [n:Quinlan] can be reached on [p:(415) 232-8876].
She moved to [a:14 rue Lepic], Paris last summer.
The parcel was addressed to [n:Oluwaseun Adeyemi], [a:221B Baker Street], London.
Visual Studio crashed twice while compiling the Falcon module.
Red Hat and Amazon Web Services both signed the agreement.
Everything sensitive goes through [e:jane dot doe at corp dot com] from now on.
You will find me at [e:m.rossi@studio-verdi.it] or [p:+39 06 4521 8890].
Passport [i:K1234567] expires in March, please renew it.
The applicant wrote her social security number, [i:412-55-9083], on the whiteboard.
Kubernetes moved the pod to worker-17 at 03:12 because memory ran out.
Ticket 5512-03-7781 was merged into ticket 5512-03-7790.
[n:Sofie Lindqvist] drafted the policy; legal still has to approve it.
Mille mercis à [n:Camille Fontaine] pour son aide précieuse.
La clé est chez Mme [n:Besson], [a:7 avenue Foch].
Wir haben [n:Jürgen Habermann] gebeten, den Vertrag zu prüfen.
Post bitte an [a:Lindenallee 23], 10115 Berlin schicken.
La señora [n:Carmona] trabaja en [a:Calle Mayor, 18].
Ayer llamó [n:Joaquín Herrero] desde el [p:+34 612 345 678].
Nobody but [n:Grace O'Donnell] has the combination of the safe.
[n:J. P. Whitaker] replied within the hour.
Interview with [n:Chen Wei-Lin] about onboarding is on Friday.
Port 8443 answers, port 9000 does not, and nginx restarts every 15 minutes.
Release notes for Mountain Lion mention a kernel panic in build 20240311-07.
[n:KOWALCZYK MAREK], born in Gdynia, holds tax id [i:83-2210457].
His driving licence [i:WHITE758231AB9CD] was photographed by the front desk.
Mail bounced for [e:tobias_k91@postbox.net], so I phoned him at [p:020 7183 4455].
Write either to [e:support-lead@harborlight.co.uk] or to [e:nina [at] harborlight [dot] co [dot] uk].
The witness, [n:Fatoumata Diallo], lives at [a:88 Orchard Grove Road, Apt 5].
Ship to: [n:Luis Ferreira], [a:1200 W. Sunset Blvd, Suite 410], Los Angeles
Kickoff with [n:Amélie], sorry, with [n:Amélie Grandjean], moved to Tuesday.
Data Lake and Feature Store are separate products of the Atlas Group.
The backup of orders_2023 took 4512 seconds and 71 percent of the disk.
Call the plumber ([p:617-555-2368]) before noon.
[n:Van der Berg, Pieter] will sign on behalf of the board.
Her DNI is [i:45872136K], check it against the scan.
Lunch with [n:Nguyen Thi Mai] was great.
git push origin main fails with error 403 on build-agent-12.
cc [n:Helga Brandt] and [n:Ravi Subramanian] on every change
Questions? [n:Molly Weatherby], ext. 4431
Contact phone for the night shift: [p:+1 303 555 0182].
Meeting room Apollo Eleven is booked by the Platform Team.
The lab sits at [a:3 Innovation Drive, Suite 200] next to the river.
Reisepass [i:C4FX82910] von [n:Matthias Oberländer] liegt vor.
Please remove [n:Zsófia Kertész] from the rota; she left in May.
It was [n:Bill] Lumbergh who asked.
Sprint Forty Two closed 18 stories, 3 of them late.
curl https://api.example.com/v2/items?limit=100 returned 502
Her new number, [p:303.555.0147], replaces the old one.
National id [i:850312-4471] belongs to a different citizen.
Invoice 2023-1187 for 1,250.00 euros was paid on 2023-11-02.
""".strip().splitlines()


def lines() -> list[tuple[str, list[tuple[int, int, str]]]]:
    out = []
    for line in LINES:
        if "[n:Bill] Lumbergh" in line or "[n:Amélie], sorry" in line:
            continue  # a first name alone: not a case by the statement of the problem
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[([nepai]):((?:[^\[\]]|\[\w+\])*)\]", line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), KINDS[m[1]]))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out

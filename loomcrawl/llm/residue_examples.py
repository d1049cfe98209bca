"""Labelled examples for the residue models: what templates leave, filler, notices, and prose.

The prose examples hold sentences about templates, errors and scripts, which are real
text, and the notices that stand around every page.
"""

RESIDUE = """
Dear {{first_name}},
Dear [[customer.name]],
Dear ${user.name},
Dear <%= name %>,
Dear @@name@@,
Dear %%first_name%%,
Dear {city},
Hello {{ user.first_name }}, welcome back!
Hi [FIRST NAME], thank you for your order
Welcome back, [[order_id]]!
Thank you for choosing %%city%%. Your parcel with %%order_id%% will arrive soon.
{{ product.name }} now from {{ product.price }} only
${user.nickname} – now from ${price}
@@shop.title@@ – now from @@price@@
%%product.name%% – now from %%price%%
{product.name} – now from {price}
{{title}}
${title}
[[title]]
<%= title %>
<%page_name%>
%%title%%
@@title@@
#{title}
#SITE_NAME#
INSERT TEXT
{% block content %}{% endblock %}
<?php echo $title; ?>
null
undefined
NaN
[object Object]
[object Object]: [object Object]
Hello undefined, you have NaN new messages
By undefined on Invalid Date
[Insert company history here] For more than [NUMBER] years [COMPANY NAME] has served the town.
[INSERT TEXT HERE]
[Insert image here]
[Your name here]
[COMPANY NAME], [STREET], [CITY]
<ADD DESCRIPTION OF THE PRODUCT> <ADD 2-3 BENEFITS>
<INSERT NAME> <ADD LINK>
TODO: replace with intro text. XXX paragraphs about the town to follow XXX
TODO: write intro. XXX more text to follow XXX
TBD: add final text before launch
Click here to edit this text. Tell your visitors a little about yourself.
This is placeholder text. Replace this text before you publish the page.
Describe your product here in a few sentences.
Write a short introduction here.
Subtitle goes here
Your headline goes here
Title goes here
Add your text here
Hier steht Ihr Text. Klicken Sie hier, um diesen Absatz zu bearbeiten.
Bitte ersetzen Sie diesen Text.
Votre texte ici. Cliquez pour modifier ce paragraphe.
Su texto aquí. Haga clic para editar este párrafo.
Welcome to {{store_name}}!
Welcome to ${company}!
Welcome to %%brand%%!
Welcome to <%= site.name %>!
Welcome to @@shop@@!
Welcome to {account_name}!
Good morning {{user.first}}, you have {{cart.count}} items in your basket.
Your order {{order.number}} from {{order.date}} has been sent to {{address.street}}.
Your order [[number]] from [[date]] has been sent to [[street]].
Your order <%= number %> from <%= date %> has been sent to <%= street %>.
Your order ${number} from ${date} has been sent to ${street}.
Your order @@number@@ from @@date@@ has been sent to @@street@@.
Your order {order_number} from {order_date} has been sent to {street_name}.
Hello %%name%%, your visit on %%date%% at %%place%% is confirmed.
[[headline]] by [[author]]
<%= headline %> by <%= author %>
{{ headline }} by {{ author.name }}
{{ meta.title }} | {{ site.name }}
{{ entry.heading }}
{% block content %}{% endblock %}
%PAGE_TITLE% | %SITE%
%HEADING%
##NAME##
#HEADLINE#
TITLE GOES HERE
INSERT TITLE HERE
ENTER TEXT
PUT YOUR TEXT HERE
null, null
null | null
null - null
undefined, undefined
undefined | undefined
undefined - undefined
NaN, NaN
NaN | NaN
NaN%
Hello null
Hello undefined
Hello [object Object]
Dear null,
Dear undefined,
Signed in as null
Signed in as undefined
Written by null, null
Written by undefined, undefined
Published on undefined at undefined
Published on null at null
Sent by [object Object] at [object Object]
Rated NaN by NaN readers
Rated undefined by undefined readers
Total: NaN EUR, null left in stock
Total: undefined, undefined left in stock
Total: [object Object], [object Object] left in stock
[photo]
[caption here]
[IMAGE DESCRIPTION]
[STREET], [POSTCODE] [CITY], [COUNTRY]
[PHONE NUMBER]
Add your own text here. Double-click to edit it and tell people who you are.
Click here to change this text and tell customers about your business.
Edit this paragraph in the editor before the page goes live.
This is a demo section. Replace this text with your own before you publish.
This is a placeholder block. Change it in the settings of the theme.
Write one or two sentences about your company here.
Describe your service here in two or three sentences.
Your headline here
Your subtitle here
Heading placeholder
Subheading goes here
"""

FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos.
Nunc velis quamque placndo mollitum ornaris etiabus remque doloris tincindo ferotum arioque utratum sedris vinm pulque.
Curem nisibus volque erotum tasque modris ambatum remris ipsoque velibus curendo quamtum placris etiatum orna dolos.
Ornam remque mollique ipsoque erobus sedbus curetum tinciris voltum tasque ariondo cureris vinndo modque feroque remtum.
Ambaque quambus ipsos pulm plac vinque ambabus utrabus veli rembus tincindo nuncris eroque placndo sedndo modris etiabus.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae donec velit neque auctor.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas vivamus pulvinar.
Aenean massa, cum sociis natoque penatibus et magnis dis parturient montes, nascetur ridiculus mus quam felis.
Tas utram plactum ipsos eroris dolotum ariondo pulque tasm ipso ornaris cure nisi volndo modtum utras dolom eros.
asdf jkl asdf jkl qwer qwer test 123
test test test test 1234 test
Sample text
Dummy text dummy text dummy text
Example text, example text, example text.
Text text text text text text.
Headline Headline Subline
bla bla bla bla bla
foo bar baz foo bar
xxx xxx xxx xxx
Beispieltext Beispieltext Beispieltext
Texte exemple texte exemple
Texto de ejemplo texto de ejemplo
qwerty qwerty asdfgh test 1 2 3 test test
asdf jkl asdf jkl asdf
test test test
This is dummy text. Dummy text dummy text dummy text.
Sample content sample content sample content.
Blah blah, blah blah blah. Blah blah, blah.
foo bar baz foo bar baz
Example page
Untitled page
"""

NOTICE = """
404
500
503
404 Not Found
Page not found
Page not found.
Oops!
Access denied
Access denied.
Forbidden
Bad gateway
Bad gateway.
Internal server error
Sorry, the page you requested could not be found.
Sorry – access denied. If this keeps happening, quote reference 24c507d06d to the help desk.
The requested address could not be found on this server.
Go back to the start page of the site.
Reference number 24c507d06d
Seite nicht gefunden.
Die angeforderte Seite wurde nicht gefunden.
Zugriff verweigert
Der Dienst ist vorübergehend nicht verfügbar.
Page introuvable.
La page demandée n'existe pas ou a été déplacée.
Accès refusé
Página no encontrada.
La página que busca no existe o se ha movido.
Acceso denegado
{"error":{"code":494,"message":"upstream refused"}}
{"error":{"code":500,"message":"upstream timed out"}}
{"status":"error","message":"internal server error","code":500}
Traceback (most recent call last):
File "/opt/app/views_page.py", line 150, in render
ValueError: invalid literal for int() with base 10
TypeError: object is not callable
java.lang.IllegalStateException: template page.ftl not bound
java.lang.NullPointerException: value is null
at org.site.View.show(View.java:58)
Warning: undefined variable $row in /srv/site/page.tpl on line 63
Warning: Cannot modify header information - headers already sent in /var/www/index.php on line 12
Fatal error: Uncaught Error in /var/www/html/index.php on line 20
Notice: Undefined index: id in /srv/site/list.php on line 4
SQL error near 'ORDER BY page_rank': connection pool exhausted
SQL error near 'SELECT id': syntax error
Database connection failed
Error establishing a database connection
You need to enable JavaScript to run this app.
Please enable JavaScript and cookies to continue
JavaScript is required to view this page.
Your browser has scripting switched off, so the page cannot be shown.
Für diese Seite muss JavaScript eingeschaltet sein.
Bitte aktivieren Sie JavaScript, um die Seite anzuzeigen.
Veuillez activer JavaScript pour afficher la page.
Active JavaScript para ver la página.
Verifying that you are human. This may take a few seconds.
Please wait while we verify your browser
Just a moment
Just a moment...
Please allow cookies in your browser to continue.
Your browser is not supported. Please upgrade.
Loading…
Loading...
Please wait…
Error 400: Bad request
Error 401: Sign-in required
Error 403: Forbidden
Error 404: Not found
Error 410: Gone
Error 429: Too many requests
Error 500: Internal server error
Error 502: Bad gateway
Error 503: Service unavailable
Error 504: Gateway timeout
Fehler 404: Diese Seite gibt es nicht
Erreur 404: cette page n'existe pas
Error 404: esta página no existe
Oops! We could not find that page.
Oops! Something went wrong.
Oops! This page has gone.
Oops! Diese Seite gibt es nicht.
Oops! Cette page n'existe pas.
Oops! Esta página no existe.
Something went wrong.
Something broke on our side. Please try again.
The service is down for the moment.
This item is no longer available.
This content has been removed by its author.
You have sent too many requests. Slow down.
The server behind us took too long to respond.
We can't find the page you asked for. It may have moved or been deleted.
Sorry, this page was not found. If it happens again, tell the help desk the reference 7f3a09c1.
The requested address /a1/b2c3 was not found on this server.
Go to the home page of this site.
Use the search box or come back later.
Request id 5d41402abc
Ray id 7d793037a0
Incident 9f86d081884c
KeyError: 'title'
at Main.run(Main.java:17)
at app.View.draw(View.java:88)
Fatal error: call to undefined function render() on null
Query failed after 30.00 s
You need to enable JavaScript to run this app.
You need to enable JavaScript to run example.com.
This site needs scripts. Turn them on in the settings of your browser and reload the page.
JavaScript is switched off. No scripts were found to be supported.
Für diese Seite muss JavaScript aktiviert sein.
Veuillez activer JavaScript pour voir ce site.
Active JavaScript para ver esta página.
Checking your browser before you can go on. It takes a few seconds.
Please wait while we make sure that you are not a robot.
One moment please
Cookies are turned off. Allow cookies and reload.
Your browser is out of date. Update it to use this application.
Please wait, loading
401
403
410
429
502
504
503 Service Temporarily Unavailable
Service temporarily unavailable
Service temporarily unavailable.
This service is temporarily unavailable. Try again later.
The site is temporarily unavailable.
Go back to the home page of this site.
Back to the start page.
429 Too many requests
Too many requests
Too many requests, please slow down.
500 Something went wrong
Something went wrong at our end.
Something went wrong, try again
This item was removed.
This entry has been removed.
This could not be served.
The file /a1/b2c3 could not be served by this host.
You need to enable JavaScript to run our shop.
You need to enable JavaScript to run this site.
You need to enable JavaScript to run news.example.org.
You need to enable JavaScript to run Exampletown.
Active JavaScript para ver el sitio.
Active JavaScript para ver la tienda.
Active JavaScript para ver Ejemplo.
Your browser offers no script support.
"""

PROSE = """
In the letter tool a field such as {{first_name}} is swapped for the reader's name when the letter is printed, and a field such as ${order.total} is filled from the till.
A template may hold a mark like [[city]] or %%name%% that the program replaces before the letter is sent to the reader.
Printers in the town used nonsense such as lorem ipsum to judge a page before the real words arrived, and some sheets have survived.
Filler in print: a short history from the valley
Mail merge without tears: the handbook of the office
Why the newspaper redesigned its 404 page
Why the library redesigned its error page and what readers said about it
A visitor who met the words "page not found" used to leave; the team now shows a map of nearby stories and 58 per cent stay.
The night the ticket office answered 503
For 8 minutes the ticket desk said "service unavailable" while a cable was replaced, and the queue stayed calm.
The town without JavaScript
We asked 18 readers to switch scripts off for a week; most pages asked them to enable JavaScript, yet the timetable still worked.
When the server was repaired the engineers wrote a long report about the error and the connection pool that had been exhausted.
Null is a value that many programs use where nothing is known, and undefined is its cousin in the browser.
Some features of the site work only with JavaScript switched on.
We use cookies to improve the site. Choose "Accept all" or manage your settings.
The site and its 188 partners store information on your device so that pages load faster and advertising can be measured. You can change your mind at any time.
Nothing on this page may be copied without written permission from the owner.
Sign up for our weekly letter and never miss a story
Follow the town on your favourite network
Last updated 5 days ago by staff
Reporting by our weather team
By the editorial desk
204 comments
Tags: ferry, anchor, beacon, harbour, library
Read more: Inside the weathered cottage at the harbour
Next article → Inside the gentle bakery at the coast
Editor's pick – A quiet year for the village
Also in Boats: How farmers surveyed the harbour
Nobody in the village remembers why the bridge was painted, yet the paperwork took longer than the work.
According to the neighbours, every second plank had to be replaced and the canal looked forgotten.
They say that almost nobody had expected it, but the borrowed pantry tells another story.
When the workshop was inspected during the long weekend, somebody kept a careful diary.
It took 37 days until the staircase behind the museum was finally questioned.
Since then the curators have admired 77 wooden places, among them the anchor and an attic.
Once surveyed, the courtyard served pupils from the north and later drivers from the coast.
What the carpenters liked most was the cautious workshop beside the chart.
The reliable station near the river was abandoned by gardeners shortly after sunrise.
A schoolhouse of this kind is uneven, and the county has 70 of them.
For the town this means that the delicate canal stays open at the end of the season.
Archivists from the city photographed the quiet courtyard, although opinions in the town remain divided.
The rule says that wet timber must rest for a year.
In the tables the same figure is given for every winter.
Measurements were taken with the old gauge and rounded.
Readers of the diary will remember how the water rose that night.
Oh valley, valley, the barrel is crowded tonight
The committee met on Tuesday to discuss the budget for the new swimming pool and the repair of the roof.
She walked along the beach every morning before breakfast, looking for shells that the tide had left behind.
The recipe needs two eggs, a cup of flour, some butter and a pinch of salt; bake it for thirty minutes.
- 45 x valley garden
- 163 cm reservoir
- 231 ml lighthouse
1. The rowing club, 34:28
Results of the regatta
Glossary of the workshop
The song of the valley
Where to read about the town
buy boat paint, boat paint online, best boat paint, boat paint review, cheap boat paint discount
garden shed | garden shed price | garden shed near me | order garden shed
#kitchen #taps #kitchentaps #online #bridge #best
northern barrels L navy SKU54868 discount
Buy bike racks because bike racks from the coast are bike racks you trust.
Many ask for copper pans: copper pans review, copper pans sale, only copper pans.
tent pegs TENT PEGS tetn pegs tnt pegs tent pges, sillas baratas, silas bartaas, baratas sillas
original garden links
deal harbour links
order village links
review cottage links
price station links
Advertisement
Sponsored content
Publicité
Publicidad
Werbung
Anzeige
Contexto
Also in Music: Griauholt Quiasvik and the familiar quarry
Ulmanulmford_57 commented: I saw the same saddle in Zanuborg!
Ystutesby_12: le dépôt!
7. Le dépôt – Kroandal Velisdell
7. Quiocote Ystauzanholm: le dépôt
Lire aussi : Le grenier – Zanarstad Tariadell
Sur le même sujet : Tariakrosk, après deux étés secs
Lea también: Griandorford Briomere: la biblioteca
Calenborg Zanumby – Juneyrwick: le four
Velarford: Ostauby
Tesumholt tramline
The owner is not responsible for the content of external pages.
tareby-gz.example is not responsible for the content of external pages.
Kroulund sillas baratas | blog.kroulund-bh.example
Die Nachbarn sagen, dass das Gewächshaus feucht wirkt und den Bahnhof niemand vermessen hat.
Weil niemand damit gerechnet hatte, wurde der Leuchtturm am späten Abend wieder besichtigt.
Am Ende war die Werkstatt schmal, und die Schülerinnen hatten den Marktplatz vermessen.
Der Hafen wurde vor dem ersten Frost gestrichen, obwohl der Regen kaum nachließ.
Für die Stadt wird die Treppe nun 52 Tage lang erneuert.
Die Katze schläft den ganzen Tag auf dem Sofa und wartet, bis die Kinder aus der Schule kommen.
Wir verwenden Cookies, um die Seite zu verbessern. Alle akzeptieren
Für Inhalte fremder Seiten übernimmt die Redaktion keine Haftung.
Nächster Artikel → Die Brücke, über Nacht
Depuis, la gare paraît humide et le jardin a été décrit.
Selon les musiciens, le verger près de la ville est modeste mais la pluie n'a pas cessé.
Comme le budget a tenu, les jardiniers ont regardé la place et la chapelle sans cérémonie.
Pour la ville, le phare a été réparé pendant 89 jours.
Les enfants jouent dans la cour pendant que leur grand-mère prépare le repas du dimanche.
En utilisant ce site, vous acceptez les cookies. Tout accepter
Article suivant → La carrière, en hiver
Según los alumnos, la biblioteca es estrecha, aunque nadie lo esperaba.
En la ciudad, el molino atrae a mucha gente por tercera vez, y el presupuesto alcanzó.
Desde entonces la capilla parece estrecha y el almacén fue medido.
Los niños juegan en el patio mientras su abuela prepara la comida del domingo.
Artículo siguiente → El puente, en primavera
© 2025. All rights reserved. Alle Rechte vorbehalten. Tous droits réservés. Todos los derechos reservados.
Ohne JavaScript lassen sich die Bilder nicht vergrößern.
Is something wrong with this article? Tell the editors
By using this site you accept our cookies.
Sign in · Join · Cart (3)
Home > Travel > Rivers
Terms · Privacy · Legal notice · Contact
Prices include tax; postage is added at the end.
Did you like this? Write to us.
Reading time: 7 minutes
Page 2 of 14
New members this week: 58
Poll: 1204 votes
Weather: 17°, cloudy, some wind
What comes next
How it is done
In brief
In a nutshell
What you will need
More details
The story so far
En deux mots
Et ensuite
En pocas palabras
Lo que sigue
Kurz gesagt
Wie es dazu kam
Lesen Sie auch: Der alte Hafen, ohne große Worte
Anmelden · Warenkorb (4)
Connexion · Panier (2)
Entrar · Cesta (1)
Como llovía, los carpinteros dejaron la biblioteca para la primavera.
green mugs 2-pack SKU4471 offer
« Back
« Back to overview
« Back to Travel
« Zurück zu Reisen
« Retour aux voyages
‹ Previous | Next ›
» More from this section
Share this page
Compartir este artículo
Reload this map to see later positions
oak tables · oak benches · oak chairs
"""

"""Fixed values for personal-information detection: names, titles, street words, endings."""

# Fixed values, in natural order.

#: Given names that anchor a personal name (Italian, English, German, Slovene).
GIVEN_NAMES = """
Alberto Alessandra Alessandro Alessia Andrea Angela Anna Antonella Antonio Barbara Bruna Bruno Carla Carlo Caterina Chiara Claudia
Claudio Cristina Daniela Daniele Dario Davide Elena Elisa Elisabetta Emma Enrico Enzo Fabio Federica Federico Filippo Francesca Francesco
Franco Gabriele Giacomo Gianni Giorgia Giorgio Giovanna Giovanni Giulia Giulio Giuseppe Ilaria Laura Lorenzo Luca Lucia Luciano Luigi
Marco Maria Mario Marta Martina Massimo Matteo Maurizio Michele Nadia Nicola Noemi Paola Paolo Patrizia Pietro Riccardo Roberta Roberto
Sandro Sara Silvia Simone Sofia Stefano Tullio Valentina Vincenzo
Alice Charles Colin David Edward Emily George Helen Henry James Jane Joan John Joseph Maeve Mark Martin Mary Michael Oliver Owen Patrick
Paul Peter Richard Robert Ruth Sarah Simon Stephen Susan Thomas William
Anton Birgit Franz Günther Hans Heinz Ingrid Johann Josef Jürgen Jutta Karl Katharina Käthe Klaus Monika Sabine Stefan Ursula Wolfgang
Aleš Andrej Bojan Boštjan Darja Franc Irena Ivan Janez Jože Katja Maja Marija Marjan Matej Mateja Mojca Nežka Petra Primož Tine Tomaž
Urška Živa
""".split()

#: Titles before a family name, without a dot.
TITLES = """
arch avv dott dottssa dr dr-ing frau ga geom gospa gospod herr ing miss mr mrs ms prof profssa sig sigra signor signora signore
""".split()

#: Words that begin with a capital at the start of a sentence, a label or a signature and are no names.
NO_NAMES = """
Abbiamo Abito Alla Alle Allo Am An Ansprechpartner Anrede Ausweis Bei Best Between Blatt Build Buongiorno Call Candidate Caro Cara Chi Codice Con
Consegnare Contact Contatto Coordinates Copia Cordiali Da Dal Dalla Dans Das Dear Deleting Demand Der Detour Dichiaro Die Directed Distinti Dne Documento
Driver Egregio Für Firma From Gentile Gli Ha Hash Ho Il Im In Index Kind La Le Lep Li List Lo Log Lungo Manca Mein Mi Mit My Na Nach Nel Nella
Node Nodo Non Nota Note Numero Odsek Only Pairs Patente Per Phone Please Point Prepoved Prijavo Protocollo Quando Queue Razlika Reported Restano Richiedente
Row Rückfragen Saluti Scheda Se Secondo Section Seen Serial Sezione Sheet Si Signed Sono Spedire Spett Sul Tel Telefon Text The Ticket Tra Turn Un Una
Unter Verbale Von Vozlišče We Weights Zwischen Zählstelle Čas Števec Števno Za Ruf Mail Email Node Via Viale Piazza Vicolo Strada Borgo Pod Ob Ulica Naselje Street Road
Lane Close Lindenstr Status Operatore Reviewer Alte
""".split()

#: Words in lower case that can't be the family name beside a given name in lower case.
PLAIN_WORDS = """
a ad ai al alla alle an and ask at auf aus bei bittet by chiede chiedere con da dal dalla das dei del della delle der des di die e ed ein for from gehen ha
has hat i il in is ist je la le li lo mit na naslov nato near no non o of on oder oddala oseba or per phone please presenti pri residente ring se
segnalato showed signed sul tel the to u un una und von wird will with wohnhaft wurde z za zu und via viale vicolo piazza erano furgone rilevatore
document reported stammt
""".split()

#: Street words that stand before the name of the street, as they are written in lower case.
STREET_BEFORE = """
via viale v.le v. piazza p.zza p.za piazzale p.le piazzetta corso c.so vicolo vic. strada str. largo l.go borgo b.go contrada c.da loc. località localita' frazione fraz.
salita calle rione ulica ul. naselje nas. trg cesta
""".split()
#: Of these, the Slovene ones: words after the first may be in lower case.
STREET_SLOVENE = {"ulica", "ul.", "naselje", "nas.", "trg", "cesta"}
#: Words inside street names that stay in lower case.
STREET_LINKS = "a al alla alle ai d da dal dalla de degli dei del dell della delle dello di e in la le lo sul sulla von van der den na nad ob pod pri".split()
#: Words before a house number.
NUMBER_WORDS = r"(?:n\.?\s?[°º]|n[°º]|nr\.?|num\.?|numero|n\.|no\.?|civ\.?|civico|hausnr\.?|nr\.|št\.?)"
#: English street words, after the name; those in the second list are abbreviations with a dot of their own.
STREET_AFTER = "Street Road Lane Close Avenue Drive Court Place Square Terrace Crescent Row Hill Gardens Grove Mews Walk Way St Rd Ln Cl Ave Ct Pl Sq Cres Gdns".split()
STREET_DOTTED = "St Ave Sq Cres Gdns Ct Pl Ln Cl Rd".split()
#: German street endings.
STREET_ENDINGS = "straße strasse str. str gasse weg platz allee ring ufer damm steig zeile".split()
#: Capitalised words that may precede a German street.
STREET_ADJECTIVES = "Alte Alter Altes Neue Neuer Neues Obere Oberer Untere Unterer Große Großer Kleine Kleiner Am An Im".split()

#: Endings of file names, which no mail host has.
FILE_ENDINGS = "gpkg csv json geojson parquet sqlite db shp dbf tif tiff png jpg jpeg svg pdf txt md xml html zip gz tar xls xlsx doc docx pbf osm py sql log yml yaml npz npy".split()

#: Words before a document number that admit its rarer forms.
ID_CUES = "documento|document|ausweis|id|carta|patente|licence|license|c.f.|cod. fisc.|codice fiscale|tax code|emšo|passaporto|passport".split("|")

#: Words and phrases after which a person is named, in lower case; the name follows after blanks, a colon or a comma.
PERSON_CUES = """
chiede di|chiedere di|chieda di|chiesto di|chiede|parlato con|parlare con|incontrato|contattare|contatto|contatto di reperibilità|referente|responsabile|richiedente|rilevatore|rilevatrice|operatore|operatrice
firmato|firma|da parte di|a nome di|nome e cognome|nome|nominativo|gentile|caro|cara|egregio|egregia|cordiali saluti|distinti saluti|saluti|presenti|presente|compilato da|redatto da|inviato da|scritto da
segnalato da|segnalata da|seguita da|seguito da|segnalazione arriva da|firmato da|a cura di|sottoscritto|sottoscritta|mi chiamo|dichiaro che|guidato il furgone|le schede a
ask for|asked for|contact|contact on site|spoke with|spoke to|speak to|met with|met|signed|signed by|reported by|led by|written by|submitted by|sent by|by|dear|best regards|kind regards|regards|sincerely|yours|my name is|name|full name|on behalf of|attn|attention|agreed with
ansprechpartner|ansprechpartner vor ort|ansprechpartnerin|kontakt|gez.|grüßen|gruß|lieber|liebe|geehrter|geehrte|ich heiße|mein name ist|verfasst von|gemeldet von|stammt von|unterschrift|gehen an|vor- und nachname
spoštovani|spoštovana|lep pozdrav|pozdrav|oseba|kontaktna oseba|odgovorna oseba|podpisan|podpisana|podpis|ime|ime in priimek|pripravil|pripravila|prijavil|prijavila
""".replace("\n", "|").strip("|").split("|")
#: Words that stand right after a person's name, perhaps behind a comma or bracket, in lower case.
PERSON_TAILS = "tel cell cellulare telefono phone mobile telefon gsm handy email e-mail mail nato nata residente abitante born geboren wohnhaft rojen rojena stanujoč stanujoča".split()

#: Family names that anchor a name beside a word of name's shape (common ones of several countries).
FAMILY_NAMES = """
Rossi Russo Ferrari Esposito Bianchi Romano Colombo Ricci Marino Greco Bruno Gallo Conti Costa Giordano Mancini Rizzo Lombardi Moretti Barbieri Fontana Santoro Mariani Rinaldi Caruso Ferrara Galli Martini Leone Longo Gentile Martinelli Vitale
Smith Jones Williams Brown Taylor Davies Wilson Evans Johnson Roberts Walker Wright Robinson Thompson Hughes Edwards Hall Green Clarke Jackson Harris Murphy Kelly Sullivan Walsh Byrne Ryan Miller Davis Anderson Campbell Stewart
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Lange Gruber Huber Steiner Moser Pichler
Novak Horvat Kovačič Krajnc Zupančič Potočnik Kovač Mlakar Kos Vidmar Golob Turk Božič Kralj Hribar Petrović Jovanović Nikolić Kowalski Nowak Nagy Kovács Popescu Ivanov Petrov
García Martínez López Sánchez Pérez González Rodríguez Fernández Silva Santos Ferreira Pereira Oliveira Dubois Dupont Moreau Laurent Lefebvre Jansen Hansen Johansson Andersson Nielsen
Hassan Ahmed Khan Singh Kumar Patel Sharma Nguyen Tran Chen Wang Zhang Kim Hussain Ibrahim Mohamed Diallo Traoré
""".split()

#: Capitalised words of places, bodies and headings that a name's shape must not take for a person.
NO_PERSONS = """
Agenzia Allegato Amt April Aprile August Autonoma Azienda Bezirk Borgo Bridge Bürger Calle Capoluogo Casa Castel Castello Centro Chapel Church Città City Colle Committee Comune Council County Dezember Department Direzione Dipartimento Est Februar
Friuli Gemeinde Giulia Gruppo Istituto Italia Januar Juli Juni Junction Kreis Land Lower März Mai Marzo Ministero Ministrstvo Monte Montag Mittwoch New Nord North November Občina Office Oktober Old Ovest Paese Park Planning Ponte Porta Posta Programma
Project Provincia Regione Repubblica Republic Rio River Road Roads Saint San Sankt Santa Santo School Scuola September Servizio Settore South Stadt Station Stato Stazione Steering Sud Sveti Team Teil Torre Town Traffic Transport Uffici Ufficio Unione University Upper
Nuova Nuovo Vecchia Vecchio Alta Alto Bassa Basso Superiore Inferiore Maggiore Minore Urad Val Valle Venezia Verkehr Villa Village West Zona Zone Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March June July October December Sir Madam Damen Herren Signori Sirs Team All Gospe Gospodje Staff Clienti Cittadini
""".split()

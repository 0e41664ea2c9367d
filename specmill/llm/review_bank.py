"""The fixed example passages of the review of unwanted language.

Fixed values, as text: "language passage". A slot in braces stands for each of its fillers.
"""

from __future__ import annotations

SLOTS = {
    "it": {
        "insulto": "imbecille; idiota; cretino; stronzo; pezzo di merda; bastardo; deficiente; testa di cazzo; coglione; fallito schifoso; povero fallito; verme schifoso; porco; scemo",
        "gruppo": "gli stranieri; gli immigrati; i profughi; i gay; le donne; i disabili; i vecchi; quelli di quella religione; gli ebrei; i neri; gli zingari",
    },
    "en": {
        "insult": "idiot; moron; dumbass; piece of shit; stupid cow; bastard; jackass; brainless fool; pathetic loser; worthless pig; asshole; bitch; scumbag",
        "group": "foreigners; immigrants; refugees; gay people; women; disabled people; old people; people of that faith; jews; black people; muslims",
    },
    "de": {
        "schimpf": "idiot; vollidiot; trottel; arschloch; mistkerl; dummkopf; versager; fauler sack; dreckskerl; depp; schwein",
        "gruppe": "ausländer; flüchtlinge; frauen; behinderte; schwule; alte; juden; muslime; leute dieses glaubens",
    },
    "fr": {
        "insulte": "connard; abruti; imbécile; crétin; pauvre type; fainéant; idiot; salaud; ordure; débile; enfoiré",
        "groupe": "étrangers; immigrés; réfugiés; femmes; handicapés; gais; homosexuels; vieux; juifs; musulmans; gens de cette religion",
    },
    "es": {
        "insulto": "imbécil; idiota; gilipollas; cabrón; pobre fracasado; hijo de puta; cretino; inútil; cerdo; estúpido; tonto de mierda",
        "grupo": "extranjeros; inmigrantes; refugiados; mujeres; discapacitados; gais; viejos; judíos; musulmanes; de esa religión",
    },
}

UNWANTED = """
it chi ha scritto questa nota è un {insulto}
it che {insulto}, sparisci e non tornare mai più
it solo un {insulto} come te può fare una cosa così
it sei solo un {insulto}, stai lontano da me
it dite a quel {insulto} di chiudere la bocca
it la prossima volta che vedo questo {insulto} gli spacco il naso
it sei un {insulto}
it ma quanto sei {insulto}
it stai zitto {insulto}
it {gruppo} sono parassiti da buttare fuori
it {gruppo} vanno messi in gabbia
it bisogna liberarsi di loro, {gruppo} sono una malattia
it {gruppo} sono subumani, mi rifiuto di stare accanto a loro
it {gruppo} sono troppo stupidi per lavorare
it fuori tutti: {gruppo} puzzano e rovinano ogni cosa
it {gruppo} non dovrebbero esistere
it {gruppo} fanno schifo, vanno cacciati tutti
it vaffanculo tu e tutti gli altri
it mi fai schifo, crepa
it spero che crepi, nessuno sentirà la tua mancanza
it se torni qui ti spacco la faccia
it ti ammazzo se ti trovo
it meriti di morire
it so dove abiti, te la faccio pagare
it figlio di puttana
it va' a morire ammazzato
it stanotte voglio fare sesso con te, nudi e senza fretta
it guarda porno e si masturba
it mandami foto nuda del tuo seno
it lei lo cavalcava nuda mentre lui gemeva
it vorrei leccarti tutta fino a farti godere
it cerco donne vogliose per sesso bollente
it voglio scoparti adesso
en whoever wrote this note is a {insult}
en what a {insult}, get lost and never come back
en only a {insult} like you could do it this way
en you are nothing but a {insult}, stay away from me
en tell that {insult} to shut the hell up
en next time i see this {insult} i will break his nose
en you are a {insult}
en shut up you {insult}
en {group} are vermin and should be thrown out
en {group} belong in cages
en we should get rid of all {group}, they are a disease
en i refuse to work with {group}, they are subhuman filth
en {group} are too stupid to work
en keep {group} out, they stink and ruin everything
en {group} should not exist
en all {group} are filthy and must go
en screw you and all the others
en fuck you and your friends
en you make me sick, go and drop dead
en i hope you get crushed to death, nobody would miss you
en come near me again and i will smash your face
en i will kill you if i find you
en you deserve to die
en i know where you live, you will pay for this
en go kill yourself
en i want to have sex with you tonight, naked and loud
en he keeps watching porn and masturbating
en send me nude pictures of your breasts
en she rode him naked while he moaned
en i would love to lick you all over until you come
en looking for horny girls for hot sex
en i want to fuck you right now
de wer das geschrieben hat, ist ein {schimpf}
de wer diese notiz geschrieben hat, ist ein {schimpf}
de nur ein {schimpf} wie du kann das so machen
de du bist nur ein {schimpf}, lass mich in ruhe
de sag dem {schimpf}, er soll die fresse halten
de was für ein {schimpf}, verschwinde und komm nie wieder
de wenn ich diesen {schimpf} noch einmal sehe, breche ich ihm die nase
de du bist ein {schimpf}
de halt die fresse du {schimpf}
de {gruppe} sind ungeziefer und gehören hinausgeworfen
de {gruppe} sind abschaum, mit denen arbeite ich nicht
de {gruppe} sind zu dumm zum arbeiten und stinken
de {gruppe} gehören in käfige
de wir müssen alle {gruppe} loswerden, sie sind eine krankheit
de {gruppe} sind untermenschen
de hau ab und verreck endlich
de fick dich und deine freunde
de ich hoffe du stirbst, niemand wird dich vermissen
de komm noch einmal her und ich schlage dir die zähne aus
de ich bring dich um
de ich will heute nacht nackt mit dir sex haben
de er schaut pornos und masturbiert
de schick mir nacktbilder von deinen brüsten
de sie ritt ihn nackt während er stöhnte
de ich will dich ficken
fr celui qui a écrit ça est un {insulte}
fr celui qui a écrit cette note est un {insulte}
fr seul un {insulte} comme toi peut faire ça
fr tu n'es qu'un {insulte}, laisse-moi tranquille
fr dites à ce {insulte} de fermer sa gueule
fr quel {insulte}, dégage et ne reviens jamais
fr la prochaine fois que je vois ce {insulte} je lui casse le nez
fr tu es un {insulte}
fr ferme ta gueule {insulte}
fr les {groupe} sont de la vermine à jeter dehors
fr les {groupe} sont trop bêtes pour travailler et ils puent
fr les {groupe} sont des sous-hommes, je refuse de travailler avec eux
fr les {groupe} doivent être mis en cage
fr il faut se débarrasser des {groupe}, c'est une maladie
fr va crever, personne ne te regrettera
fr va te faire foutre toi et tes amis
fr reviens ici et je te casse la gueule
fr je vais te tuer
fr je veux faire l'amour avec toi, nue, cette nuit
fr il regarde du porno et se masturbe
fr envoie-moi des photos de tes seins nus
fr elle le chevauchait nue pendant qu'il gémissait
fr je veux te baiser
es quien escribió esto es un {insulto}
es quien escribió esta nota es un {insulto}
es solo un {insulto} como tú puede hacerlo así
es eres solo un {insulto}, déjame en paz
es decidle a ese {insulto} que cierre la boca
es qué {insulto}, lárgate y no vuelvas nunca
es la próxima vez que vea a ese {insulto} le rompo la nariz
es eres un {insulto}
es cállate {insulto}
es los {grupo} son parásitos, hay que echarlos
es los {grupo} son demasiado tontos para trabajar y apestan
es los {grupo} son basura infrahumana, no trabajo con ellos
es las {grupo} son basura infrahumana, no trabajo con ellos
es los {grupo} deben estar en jaulas
es hay que librarse de los {grupo}, son una enfermedad
es ojalá te mueras, nadie te echará de menos
es vete a la mierda tú y tus amigos
es vuelve por aquí y te parto la cara
es te voy a matar
es quiero tener sexo contigo desnuda esta noche
es mira porno y se masturba
es mándame fotos desnudas de tus pechos
es ella lo cabalgaba desnuda mientras él gemía
es quiero follarte
it ti spacco la faccia
it ti rompo le ossa
it ti gonfio di botte
it ti faccio a pezzi
it vi odio tutti, dovete crepare
it hai una bella scopata in mente
en i will smash your face
en i will break your bones
en i will beat you up
en i will cut you to pieces
en i hate you all, you should die
en she sucked him off all night
de ich schlage dir die fresse ein
de ich breche dir alle knochen
de ich mache dich fertig
de ihr sollt alle verrecken
fr je te casse la figure
fr je vais te briser les os
fr je vais te massacrer
fr je vous hais tous, crevez
es te rompo la cara
es te voy a partir los huesos
es te voy a hacer pedazos
es os odio a todos, ojalá muráis
"""

HARMLESS = """
it gli insulti al personale vanno segnalati al capoturno
it il corso sul rispetto di stranieri e disabili è nel modulo 4
it uccidere il processo 4 e riavviare il demone
it la pompa va spurgata e il membro di spinta ingrassato
it montare il connettore femmina sul lato master e il maschio sullo slave
it che giornata, la dannata porta 4 è ancora bloccata
it il cavo nudo è esposto, va coperto con guaina
it il colpo d'ariete ha rotto la vite senza testa
it le donne e i disabili hanno posti riservati in carrozza
it chi ha scritto questa nota deve firmarla
it la prossima volta che vedo questo guasto lo segnalo al deposito
it se torni nella mia cabina trovi il manuale
it stanotte voglio fare la prova in cabina senza fretta
it mandami foto del quadro dopo il turno
it la prova è fallita, il compressore è morto
it dite a quelli del deposito di chiudere la porta
it buongiorno, saluti
it il comando disabilita la richiesta e il gruppo resta in stato di guasto
en abusive language towards staff has to be reported to the shift leader
en training on respect for foreigners and disabled people is on day 2
en the dead man's handle must kill traction
en abort the dummy run if the nipple leaks
en fit the female connector on the master side and the male one on the slave unit
en open the isolating cock 3 and bleed the line before the strip-down
en the blow-off valve sticks and the shaft penetrates the seal
en the damned door of coach 4 is stuck again, what a day
en the bare wire is exposed, cover it
en kill the process and restart the daemon
en women and disabled people have reserved seats in the coach
en whoever wrote this note must sign it
en next time i see this fault i will report it to the depot
en come near the cab again and check the display
en send me pictures of the panel after the shift
en tell the depot to shut the valve
en only a technician could wire it this way
en hello, regards
de beleidigungen des personals sind der schichtleitung zu melden
de die verdammte tür 4 klemmt schon wieder
de der blanke draht liegt frei und muss isoliert werden
de schulung zum respekt gegenüber ausländern und behinderten am tag 2
de wer das geschrieben hat, soll es unterschreiben
de schick mir bilder von der tafel
de den prozess beenden und den dienst neu starten
de guten tag, mit freundlichen grüßen
fr les insultes envers le personnel doivent être signalées
fr cette fichue porte 4 est encore bloquée
fr le fil nu est à découvert, il faut l'isoler
fr la formation au respect des étrangers et des handicapés est au module 2
fr celui qui a écrit ça doit le signer
fr envoie-moi des photos du tableau
fr tuer le processus et relancer le service
fr bonjour, cordialement
es los insultos al personal deben comunicarse al jefe de turno
es la maldita puerta 4 está otra vez atascada
es el cable desnudo está al aire y hay que cubrirlo
es el curso sobre respeto a extranjeros y discapacitados está en el módulo 2
es quien escribió esto debe firmarlo
es mándame fotos del cuadro
es matar el proceso y reiniciar el servicio
es buenos días, un saludo
it il modulo 6 tratta i diritti di chi viaggia: {gruppo}, le famiglie e i lavoratori
it le tariffe ridotte per {gruppo} valgono anche nei giorni festivi
it nel sondaggio hanno risposto anche {gruppo} di tutte le regioni
it il regolamento vieta ogni frase contro {gruppo} e prevede un richiamo
it la parola {insulto} è comparsa in una scritta sulla fiancata, da rimuovere
it nessuno può chiamare {insulto} un collega, dice il codice di condotta
it chi usa la parola {insulto} con il personale riceve un richiamo scritto
en chapter 6 covers the rights of passengers: {group}, families and workers
en reduced fares for {group} are also valid on holidays
en the survey was answered by {group} from all regions
en the rules forbid any remark against {group} and provide for a warning
en the word {insult} was sprayed on the side wall and has to be removed
en nobody may call a colleague {insult}, says the code of conduct
en whoever uses the word {insult} towards staff gets a written warning
de kapitel 6 behandelt die rechte der fahrgäste: {gruppe}, familien und arbeiter
de ermäßigte fahrkarten für {gruppe} gelten auch an feiertagen
de die regeln verbieten jede bemerkung gegen {gruppe} und sehen eine verwarnung vor
de das wort {schimpf} wurde auf die seitenwand gesprüht und ist zu entfernen
de niemand darf einen kollegen {schimpf} nennen, sagt die verhaltensregel
fr le chapitre 6 traite des droits des voyageurs: {groupe}, familles et ouvriers
fr les tarifs réduits pour les {groupe} sont valables aussi les jours fériés
fr le règlement interdit toute remarque contre les {groupe} et prévoit un avertissement
fr le mot {insulte} a été peint sur la paroi et doit être effacé
fr personne ne peut traiter un collègue de {insulte}, dit le code de conduite
es el capítulo 6 trata de los derechos de los viajeros: {grupo}, familias y obreros
es las tarifas reducidas para {grupo} valen también los festivos
es el reglamento prohíbe toda frase contra {grupo} y prevé una advertencia
es la palabra {insulto} apareció pintada en la pared y hay que borrarla
es nadie puede llamar {insulto} a un compañero, dice el código de conducta
"""

"""A small labelled table for the boilerplate classifier: pages of sites invented for it.

A line marked "-" is boilerplate, one marked "+" main body; "=" stands for a blank line. The
sites are libraries, papers, shops, clinics, forums and boards of other trades, so nothing
here is a page that the classifier is used on.
"""

PAGES = [
    """
- Portada
- Catálogo
- Novedades (4)
- Mi cuenta
- Ayuda
- Portada › Talleres › Encuadernación
=
+ Taller de encuadernación
+ Biblioteca Popular Las Acacias
+ Salta, Argentina
=
+ Acerca del taller
+ Durante ocho encuentros vas a coser, encolar y prensar tu propio cuaderno.
+ • Usamos papel reciclado y telas de la zona.
+ * Los materiales están incluidos en la cuota mensual.
+ Compartir herramientas es parte de la dinámica.
+ Inicio: 4 de junio
=
- 9 recomendaciones · 3 comentarios
- Recomendar  Comentar  Compartir
- Talleres similares
- Grabado en linóleo
- Centro Cultural El Puente
- Tucumán, Argentina
- Cerámica Salta (12)
- Ver más
=
- Acerca de · Accesibilidad · Condiciones de uso · Política de privacidad · © 2022 Las Acacias
""",
    """
- Este sitio usa cookies para recordar tus preferencias.
- Podés cambiar tu elección cuando quieras.
- Aceptar
- Rechazar todo
=
+ Dra. Inés Barrera
+ Sobre mí
+ Atiendo niños y adolescentes desde hace doce años en un consultorio de barrio.
+ Doy charlas sobre vacunas y sueño en escuelas públicas.
+ Formación
+ Me formé en el hospital municipal y en un centro de salud rural.
- Iniciá sesión para ver el resto del perfil
- Unite para escribirle a Inés
- Personas que quizás conozcas
- Bruno Salerno
- Enfermero en Clínica del Parque
- Carla Montes Rey
- Kinesióloga en Centro Norte
=
- Idioma
- Español English Português
- Centro de ayuda · Prensa · Publicidad
- Todos los derechos reservados 2021.
- Descargá la aplicación
""",
    """
- Skip to main content
- Home
- News
- Recipes
- Sign in
- Subscribe
=
+ Lentil soup for cold nights
+ The Harbour Kitchen
+ Bristol, England
+ About the recipe
+ - We use brown lentils, two carrots and a spoon of cumin.
+ • It keeps for three days and tastes better on the second.
+ Sharing a pot with the neighbours is part of the plan.
+ Our home kitchen feeds forty people a week.
- Get notified about similar recipes
+ Ingredients
+ We value patience and a heavy pot.
+ Serves: 4
- See who saved this recipe with Premium
- Similar recipes
- Barley broth
- The Corner Oven
- Cardiff, Wales
- Soup Bristol (120)
- Show more
=
- About | Privacy Policy | User Agreement | Cookie Policy
- Harbour Kitchen © 2023
""",
    """
- We use cookies to improve your visit.
- We and our 120 partners keep information on your device.
- By browsing on you accept our cookie policy.
- Accept
- Manage
- Learning > Lisbon > Pottery
+ Kiln and Wheel
=
+ Who we are
+ * Today we are a workshop of six potters.
+ We learned that slow drying beats any shortcut.
+ Languages: English and Portuguese
+ Pieces fired in 2022: 900
- 12 reactions · 4 comments
- Like  Comment  Share
- Report this post
- People also viewed
- Tom Ridley
- Glazer at Mudlark Studio
- Pottery Lisbon (31)
+ Responsibilities
+ You will prepare clay, load the kiln and help with open days.
- Sign in to see more
- Already a member?
=
- Get the app
- Community Guidelines
- English Español Português
- All rights reserved 2020.
""",
    """
- Início
- Cursos
- Pular para o conteúdo
- Cadastre-se
- Usamos cookies para melhorar sua visita.
- Nós e 18 parceiros guardamos dados no seu dispositivo.
- Aceitar
- Recusar
=
+ Professora de violão
+ Escola de Música Beira-Rio
+ Recife, Brasil
+ Sobre a vaga
+ Procuramos professora com quatro anos de sala de aula.
+ Compartilhar partituras faz parte da vaga.
+ Benefícios
+ • Oferecemos sala própria, plano de saúde e horário flexível.
+ Idiomas: português e espanhol
- 5 reações
- Gostei  Comentar  Compartilhar
- Denunciar publicação
- Entre para ver o perfil inteiro
- Páginas relacionadas
- Oficina de choro
- Casa do Samba
- Olinda, Brasil
- Ver mais
=
- Termos de uso
- Acessibilidade
- Sobre
- Todos os direitos reservados.
- Política de privacidade | Idioma
""",
    """
+ Cooperativa Río Manso
+ Quiénes somos
+ Somos una cooperativa de apicultores con base en Neuquén.
+ Mensajes clave: cuidado y paciencia.
+ Premiamos las notificaciones tempranas de plagas.
+ Puestos creados en 2021: 14
+ Valoramos la constancia y el trabajo en ronda. Me gusta registrar cada colmena, sobre todo en primavera.
- Ya tengo cuenta
- Denunciar esta publicación
- Mirá quién guardó tu perfil
+ Requisitos
+ Se requiere carnet de conducir, buen estado físico y disponibilidad en verano.
- Otras personas también vieron
- Nora Quiroga
- Veterinaria en Granja Los Sauces
- Apicultura Neuquén (8)
- Técnico en riego
- Vivero El Alba
- Bariloche, Argentina
- Acerca de  Condiciones de uso  Pautas comunitarias  Idioma
""",
    """
- El portal y terceros guardan datos en tu dispositivo.
- Respetamos tu privacidad: elegí qué datos compartís con nuestros 40 socios.
- Usamos tecnologías similares para 12 fines. Podés cambiar tus preferencias desde el pie.
- Configurar
- Iniciar sesión · Yo (1) · Personas · Notificaciones
- Personas / Quito / Guías
+ Guía de montaña
+ Beneficios
+ Ofrecemos equipo completo y seguro de vida.
- Recibí alertas de puestos como este
- Búsquedas relacionadas
- Guía Cuenca (22)
- Rescatista
- Refugio Altonevado
- Riobamba, Ecuador
+ Responsabilidades
+ El puesto responde al jefe de refugio y es de temporada.
- Change your preferences at any time under settings.
- Choose accept to consent or reject to refuse non-essential cookies.
- Reject
=
- Política de copyright
- Language
- Privacy Policy
""",
    """
- Menu
- Arts
- Sport
- Weather
- Obituaries
- Log in
=
+ Bridge repairs to close Mill Lane for a month
=
+ The county will shut Mill Lane from Monday while crews replace the deck of the old bridge.
+ Drivers are asked to use the ring road, and buses will stop at the church instead.
+ Shop owners said they were told of the dates only last week.
=
- Related articles
- Council approves new bus depot
- Flood wall opens ahead of winter
- Market hall turns one hundred
- Read more
- Subscribe to our newsletter
- Share on social media
- Terms and conditions
- Contact us
- © 2024 The Valley Courier. All rights reserved.
""",
    """
- Menú
- Política
- Deportes
- Espectáculos
- Clima
- Suscribite
=
+ Cierran el puente por un mes
=
+ El municipio va a cerrar el paso desde el lunes mientras se cambia la calzada.
+ Los colectivos pararán frente a la iglesia, y los autos irán por la ruta nueva.
=
- Notas relacionadas
- Aprueban la nueva terminal
- Inauguran la defensa costera
- Leer más
- Suscribite a nuestro boletín
- Compartir en redes
- Términos y condiciones
- Contacto
- Copyright 2024 El Correo del Valle
""",
    """
- Shop
- Cart (2)
- Wishlist
- Track order
- Help
- Shop > Garden > Tools
+ Hand trowel with ash handle
+ Forged steel blade, ash handle, made to be sharpened and passed on.
+ Care
+ Wipe the blade dry and oil the handle twice a year.
- You may also like
- Pruning knife
- Seed tray
- Add to basket
- Customers also bought
- Dibber
- Free returns within 30 days
- Sign up for offers
- Privacy · Cookies · Terms · Sitemap
""",
    """
- Tienda
- Carrito (1)
- Favoritos
- Seguí tu pedido
+ Pala de mano con mango de fresno
+ Hoja de acero forjado y mango que se puede cambiar.
+ Cuidados
+ Secá la hoja y aceitá el mango dos veces por año.
- También te puede interesar
- Cuchillo de poda
- Bandeja de siembra
- Agregar al carrito
- Registrate para recibir ofertas
- Privacidad · Cookies · Términos · Mapa del sitio
""",
    """
+ Irene Vidal
+ Trayectoria
+ Dirijo un coro de treinta voces.
- 3 reações
+ Sobre mim
+ Cantamos música de câmara e canções populares.
""",
    """
+ Night baker
+ Corner Oven Ltd.
+ Leeds, England
=
+ We value steady hands.
- Home (2) | Sign in | Premium
""",
    """
- Mi red / Rosario / Panadería
=
+ Panadería La Espiga
=
+ Valoramos la puntualidad.
- Personas
+ Delia Funes Prado
+ About me
+ Every Sunday we bake for the whole street, and there is more to come.
""",
    """
- Forum
- Threads
- Members
- New posts
- Forum > Boats > Engines
+ Outboard won't start in the cold
+ It turns over but never catches below five degrees, and I have changed both plugs.
+ Check the choke cable first, mine had slipped off its lever.
- Reply  Quote  Report
- Log in to reply
- 14 replies · 220 views
- Similar threads
- Fuel pump noise
- Propeller sizes
- Who is online
- Powered by BoardWorks
- Rules · Contact · Top
""",
    """
- Home
- Departments
- Appointments
- Careers
+ Night nurse, surgical ward
+ St. Alban Hospital
+ York, England
+ About the role
+ You will look after twelve beds with a colleague and write the morning report.
+ Requirements
+ A registration in good standing and two years on a ward.
+ Start: September
- Apply now
- Save this job
- Similar jobs
- Theatre assistant
- Hill View Clinic
- York, England
- Nurse York (40)
- Show more
- Accessibility · Modern slavery statement · Freedom of information
- Follow us
""",
    """
- Inicio · Cursos · Mensajes (2) · Yo
+ Maestra de telar
+ Taller Hilo Fino
+ Catamarca, Argentina
+ Idiomas: español y quechua
+ Acerca del curso
+ Vas a montar el telar, teñir con plantas y terminar una manta.
- Cursos similares
- Hilado en rueca
- Casa de la Lana
- Catamarca, Argentina
- Telar Belén (6)
- Ver más
+ Requisitos
+ No hace falta experiencia, solo ganas de venir cada sábado.
+ Inicio: 10 de agosto
- Recomendar  Comentar  Compartir
- Recibí alertas de cursos como este
- Mirá quién guardó tu perfil
- Acerca de | Accesibilidad | Idioma
""",
    """
+ Casa de la Lana
+ Belén, Catamarca
+ Quiénes somos
+ Somos nueve tejedoras que vendemos en ferias.
+ Idiomas: español
- Páginas que podrían interesarte
- Museo del Poncho
- Feria de los Valles
- Ver más
+ Beneficios
+ Hay guardería y almuerzo los días de taller.
- 8 recomendaciones
- Iniciá sesión para ver más datos
- Denunciar esta publicación
- Ya tengo cuenta
""",
    """
- Home · Courses · Sign in
+ Weaving teacher
+ Fine Thread Workshop
+ Galway, Ireland
+ Languages: English and Irish
+ About the course
+ You will warp the loom, dye with plants and finish a blanket.
- Similar courses
- Spinning on the wheel
- The Wool House
- Galway, Ireland
- Weaving Sligo (7)
- Show more
+ Requirements
+ No experience is needed, only a free Saturday.
+ Start: 10 August
- Like  Comment  Share
- Get notified about similar courses
- See who saved your profile
- About | Accessibility | Language
""",
    """
+ The Wool House
+ Galway, Ireland
+ Who we are
+ We are nine weavers who sell at fairs.
+ Languages: English
- Pages you may like
- Poncho Museum
- Valley Fair
- Show more
+ Benefits
+ There is a crèche and lunch on workshop days.
- 8 reactions
- Sign in to see more
- Report this post
- Already a member?
""",
    """
- Início · Cursos · Entrar
+ Professora de tear
+ Oficina Fio Fino
+ Olinda, Brasil
+ Idiomas: português e francês
+ Sobre o curso
+ Você vai montar o tear, tingir com plantas e terminar uma manta.
- Vagas similares
- Fiação na roca
- Casa da Lã
- Olinda, Brasil
- Tear Recife (5)
- Ver mais
+ Benefícios
+ Há creche e almoço nos dias de oficina.
- Gostei  Comentar  Compartilhar
- Cadastre-se para receber alertas
- Sobre | Acessibilidade | Idioma
""",
    """
- Personas que quizás conozcas
- Nélida Arce
- Tejedora en Casa de la Lana
- Omar Sosa
- Hilandero en Taller Hilo Fino
=
+ Sobre mí
+ Tejo desde los nueve años y enseño desde los treinta.
- People also viewed
- Rose Kane
- Dyer at The Wool House
=
+ About me
+ I dye wool with walnut husks and lichen.
+ Puestos cubiertos en 2020: 3
+ Experiencia
+ Durante diez años vendí mantas en la feria.
""",
    """
- El sitio y terceros guardan datos en tu dispositivo.
- Este sitio usa cookies propias.
- Al seguir aceptás nuestra política de cookies.
- Aceptar todo
- Rechazar
+ Hilandera
+ Casa de la Lana
+ Belén, Catamarca
+ Responsabilidades
+ Hilar, devanar y anotar el peso de cada madeja.
- Otras personas también vieron
- Nélida Arce
- Tejedora en Casa de la Lana
- Búsquedas relacionadas
- Lana Belén (4)
- Telar Salta (9)
+ Requisitos
+ Buena vista y paciencia.
- Denunciar esta publicación
- Unite para ver más
=
- Centro de ayuda
- Condiciones de uso
""",
    """
+ Luthier
+ Taller Arce
+ Tilcara, Argentina
+ Acerca del puesto
+ Vas a cepillar tapas, pegar aros y probar cada guitarra.
+ Idiomas: español
+ Inicio: 3 de marzo
+ Puestos abiertos en 2020: 2
+ Requisitos
+ • Oído fino y manos firmes.
+ Avisamos las fallas apenas aparecen.
""",
    """
+ Taller Arce
+ Tilcara, Argentina
=
+ Quiénes somos
+ Somos tres luthiers con base en la Quebrada.
+ Idiomas: español e italiano
+ Notas clave: silencio y paciencia.
+ Compartir plantillas con otros talleres es nuestra costumbre.
+ Beneficios
+ Almuerzo diario y taller propio.
""",
    """
+ Instrument maker
+ Arce Workshop
+ Cork, Ireland
+ About the role
+ You will plane tops, glue ribs and play every guitar.
+ Languages: English and Irish
+ Start: 3 March
+ Jobs opened in 2020: 2
+ Requirements
+ A fine ear and steady hands.
+ Home visits are part of the service.
""",
    """
+ Arce Workshop
+ Who we are
+ We are three makers who share one bench.
+ Languages: English and Italian
+ Key notes: silence and patience.
+ Responsibilities
+ Sweep, sharpen, listen.
""",
    """
+ Ofelia Arce
+ Trayectoria
+ Construí cuarenta guitarras y dos arpas.
+ Idiomas: español y guaraní
+ Sobre mí
+ Me gusta el cedro viejo.
+ Experiencia
+ Taller Arce
+ Tilcara, Argentina
""",
    """
+ Construtor de violas
+ Oficina Arce
+ Ouro Preto, Brasil
+ Sobre a vaga
+ Você vai lixar tampos e afinar cada viola.
+ Idiomas: português e espanhol
+ Início: 3 de março
+ Benefícios
+ Almoço e oficina própria.
""",
]

"""A small labelled table for the residue classifier: messages invented for it.

One message to a line under the class it belongs to. Digits are masked as in the messages.
"""

LABELLED = {
    "error": """
404 Not Found
Error 404: the page you asked for is gone
403 Forbidden
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Time-out
HTTP Error 400. The request is badly formed.
The requested URL was not found on this server.
The page you requested could not be found.
Sorry, this page isn't available.
Sorry, the link you followed may be broken or the page may have been removed.
This content is no longer available.
This posting no longer exists or has moved to another address.
Error establishing a database connection
We are having trouble reaching the database, please retry later.
Something went wrong on our side.
Something went wrong, please try again.
Oops! Something broke.
Oops, we can't find that page
Whoops, looks like an error occurred.
An unexpected error has occurred.
An error occurred while processing your request.
Please try again later.
Try again in a few minutes.
Error code: 1020
Error code 0x80004005
Error 12 while loading the view
Access denied.
You don't have permission to access this resource.
You do not have access to this page.
You are not authorised to view this page.
Too many requests.
Rate limit exceeded, wait 30 seconds and retry.
Your session has timed out.
Your session expired, sign in again.
Please log in again to continue.
The server encountered an internal error and was unable to complete your request.
The server is temporarily unavailable due to maintenance.
The service is temporarily unable to process your request.
We could not load this page, try again later
Our server is temporarily unavailable
Connection timed out
upstream timed out while reading response header from upstream nginx
Traceback (most recent call last):
File "/app/main.py", line 88, in render
KeyError: 'title'
KeyError:
ValueError:
TypeError: cannot read properties of null
AttributeError: object has no attribute
NullPointerException at com.acme.web.View
Fatal error: Uncaught exception in /var/www/html/index.php on line 12
Warning: Undefined index: name in /var/www/page.php on line 7
Notice: Undefined variable: total in /srv/app/view.php
{"error":{"code":404,"message":"resource not found"}}
{"status":500,"error":"internal error"}
{"message":"service not available","status":503}
Página no disponible
La página que buscás no existe.
La página solicitada no fue encontrada.
404 - Página no encontrada
Error 404 página inexistente
El contenido que querés ver fue eliminado o cambió de dirección.
Este aviso ya no existe o fue movido.
La publicación ya no está disponible.
Ha ocurrido un error inesperado.
Ocurrió un error al cargar la vista.
No pudimos cargar el contenido.
No pudimos cargar esta página, reintentá más tarde.
Algo salió mal.
Intentá de nuevo en unos minutos.
Vuelve a intentarlo más tarde.
Esperá 10 minutos y volvé a probar.
Demasiados pedidos, esperá unos segundos.
Esperá unos minutos y volvé a intentarlo.
Demasiadas solicitudes desde tu conexión.
Acceso denegado
Acceso denegado: no tenés permiso.
No tiene permisos para acceder a esta página.
No tienes permiso para ver este contenido.
Tu sesión venció, volvé a ingresar.
La sesión ha caducado.
El servidor no está disponible temporalmente.
Error interno del servidor
Página não encontrada
A página que você procura não existe mais.
Erro 500 interno do servidor
Ocorreu um erro inesperado.
Algo deu errado, tente novamente mais tarde.
Tente novamente em alguns minutos.
Acesso negado
Você não tem permissão para acessar esta página.
Sua sessão expirou, entre novamente.
Muitas solicitações, aguarde e tente de novo.
Não foi possível carregar esta página.
""",
    "script": """
JavaScript is disabled in your browser.
Please enable JavaScript to continue using this site.
Please enable JavaScript and reload the page.
You need to enable JavaScript to run this app.
This site requires JavaScript.
This page needs scripts to work.
This website requires scripts; allow them and reload.
Turn JavaScript on and refresh the page.
Turn on scripts and reload to see the content.
If the page does not load, allow scripts for this site.
If nothing appears, enable scripts in your browser.
Scripts are blocked, allow them for this address.
Please enable cookies to continue.
Enable JavaScript and cookies to continue
Just a moment...
Checking your browser before accessing the site.
Checking if the site connection is secure
Verifying your browser, this may take a few seconds
Verify you are human by completing the action below.
Please verify that you are a human
Are you a robot?
Confirm that you are not a robot.
Complete the captcha to continue.
Please solve this captcha
Your browser is not supported.
Your browser is out of date, update it to view this page.
This browser does not support scripts
Please update your browser to see the profile.
DDoS protection by the host; your browser will redirect shortly.
Needs JavaScript enabled
Activá JavaScript para continuar.
Tenés que activar JavaScript para usar esta página.
Necesitás habilitar JavaScript en tu navegador.
Debe habilitar JavaScript para ver este sitio.
Esta aplicación requiere JavaScript.
Este sitio necesita scripts; habilitalos y recargá.
JavaScript está desactivado en su navegador.
Verificá que sos humano para seguir.
Verificamos que seas una persona antes de continuar.
Comprobando tu navegador antes de continuar
Confirmá que no sos un robot
Completá el captcha para continuar
Tu navegador no es compatible con esta página.
Su navegador no es compatible, actualícelo.
Actualizá tu navegador para ver la página.
Actualizalo para ver el contenido.
Habilite las cookies para continuar.
Seu navegador não é compatível.
É preciso ativar o JavaScript para ver esta página.
Ative o JavaScript no seu navegador para continuar.
Este aplicativo precisa de JavaScript ativado.
JavaScript desativado no navegador
Verifique que você é humano para continuar.
Confirme que você não é um robô
""",
    "filler": """
Lorem ipsum dolor sit amet
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam quis nostrud exercitation ullamco laboris.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum.
lorem ipsum lorem ipsum dolor lorem ipsum amet lorem ipsum dolor
dolor amet ipsum dolor elit amet ipsum lorem dolor elit ipsum amet dolor lorem
tempus varia lumen tempus lumen varia rota tempus rota lumen varia tempus lumen rota
karo velim karo tuno velim sabra tuno karo sabra velim tuno karo velim sabra karo
asdf asdf asdf
asdfgh qwerty asdfgh
qwerty qwerty asdf qwerty
aaaa bbbb aaaa bbbb
foo bar baz foo bar
test test test test
testing testing testing
prueba prueba prueba, borrar
esto es una prueba, borrar después
prueba de carga, borrar luego
teste teste teste, apagar
Sample text
Sample description
Sample job posting 1
Sample job
Example job ad 3
Dummy text for the layout.
This is placeholder text used for layout only.
Placeholder
Placeholder text
Some placeholder text for now
The designer left placeholder text here
The editor put placeholder text here for now
The page only says placeholder text
The team put dummy text there for now
The box shows sample text now
The bio is a placeholder
This text is a dummy, for layout purposes.
Your text here
Your description here.
Insert your text here
Type your summary here
Write your bio here (max 300 characters)
Replace this text before publishing.
Replace this paragraph with the real description.
Description goes here
Title goes here
Content to be added
Add description
Coming soon
Under construction
TODO: write this section
TODO
TODO: complete
TBD
TBD by marketing
To be defined
Loading
Loading, please wait...
Loading...
Please wait
Texto de prueba.
Texto de relleno
Texto de ejemplo para la maqueta.
Este es un texto de ejemplo.
Escribí acá tu descripción
Escribí aquí tu resumen (máx. 300 caracteres)
Escriba aquí su texto
Ingresá tu texto acá
Reemplazar este texto
Reemplazá este párrafo por el texto definitivo.
Reemplace este texto antes de publicar.
Contenido pendiente
Próximamente
Página en construcción
Completar
Cargando
Cargando...
Cargando, esperá un momento
Texto de exemplo
Escreva aqui a sua descrição
Substitua este parágrafo pelo texto final.
Em breve
Carregando
Carregando...
Em construção
""",
    "ordinary": """
page not found rates fell by a third after the redesign
internal server error rates fell in march
We redesign error pages so that visitors smile.
Error pages for shops are part of the brief.
Access denied dialogs are one of the screens you will draw.
You will write friendly messages for every error screen.
You will turn vague warnings into clear notices.
We cut 500 errors by half last year.
The team reduced timeouts and 502 errors on the portal.
Our alerts fire when the session expires too often.
Our templates print the user name on the server and tests cover it.
The mail template greets people by name and is never empty in production.
We replaced lorem ipsum with real copy in all mock-ups.
No placeholder copy leaves the studio.
No more dummy copy in our drafts.
No more lorem ipsum or filler in the prototypes we show.
No more broken links on the site since June.
We draw pages that tell people to try again later.
We plan screens that say sorry in a friendly way.
Todo el mundo colabora.
Todo el equipo llegó temprano.
Luego vino la fiesta.
luego
We no longer use dummy text in prototypes.
The workshop covers how to write error messages that help.
The article explains what a captcha is and why visitors dislike it.
We are looking for someone who masters JavaScript.
Experience with JavaScript and Vue is required.
You will work with JavaScript, TypeScript and CSS every day.
JavaScript developer for a regional bank.
We write scripts that automate the weekly reports.
Good knowledge of browsers and accessibility is welcome.
You will keep our loading times under a second.
The loading dock is in Rosario.
Coming from another field is welcome.
Please send your application by Friday.
Please tell us about your experience.
Our servers run in two regions.
Our site serves a million visitors a month.
Our services are used by banks and shops.
We could grow a lot with your help.
Sign in bonus and a yearly budget for courses.
Wait times at the clinic fell to ten minutes.
She found the page torn from the book.
The test plan covers the payment flow.
Sample collection in the laboratory takes place at night.
The error margin of the survey is two points.
He was denied access to the archive for years.
The permission to build came after a year.
Too many requests reach the help desk on Mondays, so we are hiring.
The temporary staff were able to finish on time.
The internal audit found no mistake.
Undefined roles make teams slow, so we define them early.
File names follow the house style.
This job requires patience and good humour.
This role needs someone who enjoys order.
The view from the office is lovely.
The profile works with product and data.
We value clear communication and autonomy.
We work with Java and Go in a small team.
We offer flexible hours, English classes and private healthcare.
For 6 years I worked in logistics for retail clients.
Today I lead a team of 8.
I like to document interfaces and mentor new colleagues.
You get a birthday off and three weeks of leave.
The position reports to the data area and is hybrid.
This quarter we merged two squads and there is more to come.
If you enjoy farming software, here you can shape the backlog.
Thank you for reading.
Thanks to all who came.
Hello and welcome.
Acme Robotics
Brightwater Clinics Ltd.
Nordvik Software
Estudio Marfil SRL
Talleres Lumbre S.A.
Grupo Andino Ltda.
Maria Teresa Lopes
John Carter, analyst
Join us!
Sumate al equipo
Venha trabalhar conosco
A:
P:
By hand
First come, first served
Readers write to us
https://www.example.test/jobs/view/12/?a=1
def total(x): return x + 1
for (int i = 0; i < 10; i++) { sum += i; }
95% ok
ok
!?
数据团队正在招聘
Мы растём
keep the services running and keep the services tidy
mantener los servicios y mantener la calma
manter os serviços e manter a calma
Buenos Aires, Argentina
Senior analyst
Requirements
About us
Benefits
Responsibilities
Diseñamos páginas de error amables para comercios.
Hacemos pantallas de error que ayudan a la gente.
Bajamos los errores 500 del sitio a la mitad.
Bajamos los tiempos de carga del portal.
Los errores de la aplicación se revisan cada lunes.
Medimos cuántas sesiones expiran por día.
Buscamos a alguien que domine JavaScript y le guste enseñar.
Trabajamos con JavaScript y Vue todas las semanas.
Conocimientos de JavaScript, HTML y CSS.
Activamos alertas cuando el servidor responde lento.
Reemplazamos los textos de relleno por contenido real.
La plantilla de correo saluda por nombre y nunca queda vacía.
Ningún prototipo sale con texto de ejemplo.
Escribimos mensajes de error claros.
Vas a escribir los avisos de acceso denegado del portal.
Vas a convertir avisos confusos en páginas amables.
La persona que buscamos tiene permiso de trabajo.
El servidor de correo lo mantiene otro equipo.
El navegador más usado por nuestros clientes es conocido.
Las pruebas de carga las hace otro equipo.
La carga horaria es de seis horas.
La página institucional la renueva el área de diseño.
El contenido lo revisa el equipo de redacción.
Este puesto requiere paciencia y orden.
Esta semana sumamos dos personas.
Próximo encuentro en Córdoba, con sorteo.
Intentamos que las reuniones sean cortas.
Esperamos tu mensaje.
Se requiere manejo de Go, comunicación clara y disponibilidad en Lima.
Ofrecemos guardería, bono anual y horario flexible.
Durante 5 años trabajé en pagos para clientes de salud.
Hoy lidero un equipo pequeño de 4 personas.
Me gusta limpiar catálogos y acompañar a quienes ingresan.
Somos un grupo curioso dedicado a seguros, con base en Bogotá.
Si te interesa turismo, acá vas a poder priorizar el trabajo con negocio.
La posición reporta al área de datos y es remota.
Este trimestre cerramos la deuda más vieja, y queda mucho por hacer.
Aprendimos que las ganas pesan más que los certificados.
Gracias por llegar hasta acá.
Requisitos
Responsabilidades
Acerca del empleo
Analista senior
Criamos páginas de erro simpáticas para lojas.
Reduzimos os erros do portal pela metade.
Trabalhamos com JavaScript e React todos os dias.
Você vai criar mensagens de erro claras.
Procuramos alguém que domine JavaScript.
Os textos de exemplo saem antes da publicação.
A sessão de treinamento dura duas horas.
O acesso ao prédio é pela rua de trás.
A página da empresa é mantida pelo time de conteúdo.
Oferecemos plano de saúde, bônus anual e horário flexível.
O time de dados procura alguém para revisar os painéis.
Somos um grupo pequeno voltado a logística, em Recife.
Neste trimestre unificamos os relatórios, e ainda há muito a fazer.
Valorizamos olhar analítico e autonomia.
Buscamos coordenador com 3 anos em varejo.
Requisitos e benefícios
Sobre a vaga
""",
}
